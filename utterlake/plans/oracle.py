"""The same queries in SQL, over the same tables."""

from __future__ import annotations

from ..functions import text
from ..operators.corpus import COMPOSITIONS
from ..operators.filters import APPROVED, CONVOLUTIONS
from .queries import JOBS

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2_class(characters: str) -> str:
    return "[" + "".join("\\" + x if x in "\\[]^-" else x for x in characters) + "]+"


def gsub(x: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def squeeze(x: str) -> str:
    return f"trim({gsub(x, WS + '+')}, ' ')"


def translated(x: str, a: str, b: str) -> str:
    return f"translate({x}, {q(a)}, {q(b)})"


def digits(x: str) -> str:
    import unicodedata

    nd = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"]
    return translated(x, "".join(nd), "".join(str(unicodedata.digit(c)) for c in nd))


def plain(x: str) -> str:
    return gsub(f"regexp_replace({x}, {q(f'^language{WS}+[^<]+<asr_text>')}, '')", f"^{WS}+|{WS}+$", "")


def after(x: str) -> str:
    return f"regexp_replace({x}, '^(?s:.*?)<asr_text>', '')"


def reform(x: str) -> str:
    return translated(gsub(x, f"[{text.LAM_ALEF}]", "لا"), *text.shape_pairs())


def standard(x: str) -> str:
    return f"trim({gsub(gsub(gsub(reform(f'lower({x})'), re2_class(text.STANDARD_PUNCTUATION)), f'[^ {text.STANDARD_LETTERS}]+', ''), ' +')}, ' ')"


def ctc(x: str) -> str:
    body = gsub(gsub(translated(after(x), text.FOLDED, text.FOLDED_TO), re2_class(text.CTC_PUNCTUATION)), "[ً-ْ]", "")
    return squeeze(f"lower({translated(body, text.ZWNJ, ' ')})")


def evaluated(x: str) -> str:
    return squeeze(gsub(digits(translated(plain(x), "يك" + text.ZWNJ, "یک ")), rf"[\p{{P}}{text.NEW_PUNCTUATION}]"))


def blank(x: str) -> str:
    return f"coalesce({gsub(x, WS + '+', '')}, '') = ''"


SPLIT = "CASE WHEN lower(trim(split)) IN ('dev', 'valid') THEN 'validation' ELSE coalesce(nullif(lower(trim(split)), ''), 'train') END"
PRIORITY = "CASE {} WHEN 'test' THEN 2 WHEN 'validation' THEN 1 ELSE 0 END"
U = f"u AS (SELECT * REPLACE ({SPLIT} AS split) FROM utterances)"
PROMOTED = f"""{U}, promoted AS (
    SELECT * REPLACE ((['train', 'validation', 'test'])[max({PRIORITY.format("split")}) OVER (PARTITION BY source_id) + 1] AS split), split AS original_split FROM u
)"""
KEPT = f"{PROMOTED}, kept AS (SELECT *, pcm_sha256 IS NULL OR row_number() OVER (PARTITION BY pcm_sha256 ORDER BY {PRIORITY.format('split')} DESC, ordinal) = 1 AS kept FROM promoted)"
STATS = "SELECT split, count(*) AS samples, round(sum(duration) / 3600, 4) AS hours, count(DISTINCT source_id) AS source_recordings FROM kept WHERE kept GROUP BY split"


def coded(x: str, table: str) -> str:
    return f"coalesce(array_to_string(list_transform({x}, lambda t: chr(CAST(33 + list_position({table}, t) AS INTEGER))), ''), '')"


def edits(a: str, b: str) -> str:
    table = f"list_distinct(list_concat({a}, {b}))"
    return f"levenshtein({coded(a, table)}, {coded(b, table)})"


def scored(form) -> str:
    """Errors and reference units of each row with a prediction, in a form."""
    return f"""scored AS (
    SELECT ordinal, source, {form("coalesce(text, '')")} AS r, {form("asr_prediction")} AS h FROM utterances WHERE asr_prediction IS NOT NULL
), tokens AS (
    SELECT ordinal, source, list_filter(string_split({gsub('r', WS + '+')}, ' '), lambda x: x <> '') AS rw, list_filter(string_split({gsub('h', WS + '+')}, ' '), lambda x: x <> '') AS hw,
        list_filter(string_split(r, ''), lambda x: x <> '') AS rc, list_filter(string_split(h, ''), lambda x: x <> '') AS hc FROM scored
), errors AS (
    SELECT ordinal, source, CAST({edits("rw", "hw")} AS BIGINT) AS word_errors, CAST(len(rw) AS BIGINT) AS words,
        CAST({edits("rc", "hc")} AS BIGINT) AS char_errors, CAST(len(rc) AS BIGINT) AS chars FROM tokens
)"""


SCORED = scored(ctc)
RATES = """SELECT source, CAST(sum(word_errors) AS BIGINT) AS word_errors, CAST(sum(words) AS BIGINT) AS words, CAST(sum(char_errors) AS BIGINT) AS char_errors, CAST(sum(chars) AS BIGINT) AS chars,
            round(sum(word_errors) / nullif(sum(words), 0), 6) AS wer, round(sum(char_errors) / nullif(sum(chars), 0), 6) AS cer FROM errors GROUP BY source"""

REASONS = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"


def reasons(**checks: str) -> str:
    return REASONS.format(", ".join(f"CASE WHEN {c} THEN {q(n)} END" for n, c in checks.items()))


APPROVED_SQL = f"lower({squeeze('approved')}) IN ({', '.join(map(q, APPROVED))})"


def frames(n: str) -> str:
    for kernel, stride in CONVOLUTIONS:
        n = f"(floor(({n} - {kernel}) / {stride}.0) + 1)"
    return f"CAST({n} AS BIGINT)"


def volume(name: str, share: float) -> str:
    return f"""SELECT id, '{name}' AS volume FROM (
        SELECT id, row_number() OVER (ORDER BY sha256('volume42' || id), id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM (SELECT * REPLACE ({SPLIT} AS split) FROM utterances) WHERE source = 'elderly' AND split = 'train')
    ) WHERE k <= greatest(1, round_even(n * {share}, 0))"""


def composed(members: str) -> str:
    """Counts of a corpus after promotion and content deduplication."""
    return f"""WITH {U}, valid AS ({members}), promoted AS (
            SELECT * REPLACE ((['train', 'validation', 'test'])[max({PRIORITY.format("split")}) OVER (PARTITION BY source_id) + 1] AS split) FROM valid
        ), kept AS (SELECT *, pcm_sha256 IS NULL OR row_number() OVER (PARTITION BY pcm_sha256 ORDER BY {PRIORITY.format("split")} DESC, ordinal) = 1 AS kept FROM promoted) {STATS}"""


COMPOSED = ", ".join(f"({q(n)}, {q(s)})" for n, members in COMPOSITIONS.items() for s in members)
LEAKS = " UNION ALL ".join(
    f"""SELECT '{key}' AS key, '{a}' AS split_a, '{b}' AS split_b, (SELECT count(*) FROM (
        SELECT {key} FROM u WHERE {key} IS NOT NULL AND split = '{a}' INTERSECT SELECT {key} FROM u WHERE {key} IS NOT NULL AND split = '{b}')) AS shared"""
    for key in ("source_id", "pcm_sha256", "speaker_id") for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))
)
JOB_VALUES = ", ".join(f"({q(i)}, {q(s)}, {p}, {d}::VARCHAR[])" for i, s, p, d in JOBS)


STEM = "regexp_replace(regexp_extract({}, '[^/]*$'), '(.)\\.[^.]*$', '\\1')"
HASHED = "CASE WHEN ('0x' || substr(sha256('42:' || {0}), 1, 12))::BIGINT % 100 < 10 THEN 'test' WHEN ('0x' || substr(sha256('42:' || {0}), 1, 12))::BIGINT % 100 < 20 THEN 'validation' ELSE 'train' END"
VERIFIED = "coalesce(lower(trim({})) IN ('speaker_1', '1'), false)"


def adapter_sql() -> str:
    name = STEM.format("audio")
    or_unknown = lambda x: f"coalesce(nullif({x}, ''), 'unknown')"
    ganjoor = f"'ganjoor:' || regexp_replace({name}, '_chunk_.*$', '')"
    filimo = f"'filimo:' || CASE WHEN regexp_full_match({name}, '[0-9]{{10}}') THEN substr({name}, 1, 5) ELSE regexp_extract(audio, '([^/]+)/[^/]*$', 1) END"
    senior = f"'seniortalk:' || coalesce(nullif(regexp_extract({name}, '^(Elderly[0-9]+)(S[0-9]+)', 1), ''), {name})"
    kinds = {
        "elderly": (f"'elderly_' || {name}", "'elderly:' || regexp_replace(source_id, '^elderly:', '')", or_unknown("speaker_id"), "Persian", f"last(split ORDER BY ordinal) OVER (PARTITION BY {name})", VERIFIED.format(or_unknown("speaker_id")), 0.25, 30),
        "ganjoor": ("'ganjoor_' || lpad(CAST(ordinal AS VARCHAR), CAST(greatest(6, length(CAST(ordinal AS VARCHAR))) AS INTEGER), '0')", ganjoor, or_unknown(squeeze("speaker_id")), "Persian", HASHED.format(f"({ganjoor})"), "false", 2, 20),
        "filimo": (f"'filimo_' || {name}", filimo, "'unknown'", "Persian", HASHED.format(f"({filimo})"), "false", 2, 20),
        "mozilla": (f"'mozilla_' || {name}", f"'mozilla:' || {name}", or_unknown("speaker_id"), "Persian", "split", "false", 2, 20),
        "seniortalk": (f"'seniortalk_' || {name}", senior, f"coalesce(nullif(regexp_extract({name}, '^(Elderly[0-9]+)(S[0-9]+)', 2), ''), 'unknown')", "Chinese", "split", "false", 0.25, 30),
    }
    one = lambda s, k: f"SELECT {k[0]} AS id, {k[1]} AS source_id, {k[2]} AS speaker_id, '{k[3]}' AS language, {k[4]} AS split, {k[5]} AS human_verified, CAST({k[6]} AS DOUBLE) AS least, CAST({k[7]} AS DOUBLE) AS most FROM utterances WHERE source = '{s}'"
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(one(s, k) for s, k in kinds.items()) + ")"


def drawn(group: str) -> str:
    return f"('0x' || substr(sha256(id || ':{group}:42'), 1, 8))::BIGINT / 4294967296.0"


COMPONENTS = """e AS (SELECT DISTINCT source_id AS node, unnest(['audio:' || audio_sha256, 'text:' || text_sha256]) AS key FROM recordings),
    links AS (SELECT DISTINCT a.node AS a, b.node AS b FROM (SELECT * FROM e WHERE key IS NOT NULL AND node IS NOT NULL) a JOIN e b USING (key)),
    reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
    tied AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


def more_sql() -> dict[str, str]:
    chosen = [volume(n, s).replace(f"'{n}' AS volume", "1") for n, s in (("025", 0.25), ("050", 0.5), ("075", 0.75))]
    public = ", ".join(map(q, COMPOSITIONS["public"]))
    volumes = [
        f"SELECT '{n}' AS volume, * FROM (" + composed(f"SELECT * FROM u WHERE source IN ({public}) OR (source = 'elderly' AND (split <> 'train' OR id IN (SELECT id FROM ({c}))))") + ")"
        for n, c in zip(("025", "050", "075"), chosen)
    ]
    pair = f"regexp_replace(regexp_replace(lower({{}}), '^(voice|audio|recording|text|transcript)[-_ ]*', ''), '[^0-9a-z{chr(0x600)}-{chr(0x6FF)}]+', '', 'g')"
    key = lambda x: f"coalesce(nullif({pair.format(x)}, ''), lower({x}))"
    bare = lambda x: f"regexp_replace({x}, '\\.[^./]*$', '')"
    label = ctc("coalesce(text, '')")
    named = "CASE lower(language) WHEN 'fa' THEN 'Persian' WHEN 'zh' THEN 'Chinese' WHEN 'zh-cn' THEN 'Chinese' WHEN 'ja' THEN 'Japanese' WHEN 'en' THEN 'English' ELSE language END"
    left = ["background", "gain", "pause", "distortion", "frequency"]
    chance = {"background": 0.75, "gain": 0.8, "pause": 0.7, "distortion": 0.8, "frequency": 0.8}
    odd = "[<>&\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1f}\\x{85}\\x{2028}\\x{2029}]"
    return {
        "adapter_rows": adapter_sql(),
        "noise_suite": "SELECT CAST(vec_id AS VARCHAR) AS id, unnest(['snr20', 'snr10', 'snr5', 'rir', 'channel', 'combined']) AS condition, CAST(len(embedding) AS BIGINT) AS samples FROM embeddings",
        "incomplete_recordings": f"""WITH c AS (SELECT source_id, chunk_id, coalesce(min(text), '') AS t, coalesce(min(sentence), '') AS s FROM utterances WHERE chunk_id IS NOT NULL GROUP BY ALL),
            j AS (SELECT source_id, string_agg(t, ' ' ORDER BY chunk_id) AS t, string_agg(s, ' ' ORDER BY chunk_id) AS s FROM c WHERE source_id IS NOT NULL GROUP BY source_id) SELECT source_id FROM j WHERE {squeeze('t')} <> {squeeze('s')}""",
        "review_flags": f"SELECT ordinal, {blank('sentence')} OR alignment_wer IS NULL OR alignment_wer > 0.55 AS needs_review, {VERIFIED.format('speaker_id')} AS human_verified FROM utterances",
        "ctc_vocabulary": f"""WITH c AS (SELECT DISTINCT unnest(string_split({ctc('text')}, '')) AS c FROM utterances WHERE text IS NOT NULL), n AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM c WHERE c <> '')
            SELECT CASE WHEN c = ' ' THEN '|' ELSE c END AS character, k AS number FROM n UNION ALL SELECT '[UNK]', count(*) FROM n UNION ALL SELECT '[PAD]', count(*) + 1 FROM n""",
        "composition_audit": f"""WITH {U}, c(composition, source) AS (VALUES {COMPOSED}), h AS (SELECT DISTINCT source FROM utterances),
            r AS (SELECT composition, count(*) - count(h.source) AS missing FROM c LEFT JOIN h ON c.source = h.source GROUP BY composition),
            e AS (SELECT composition, split, 's' AS key, source_id AS value FROM u JOIN c USING (source) UNION ALL SELECT composition, split, 'p', pcm_sha256 FROM u JOIN c USING (source)),
            t AS (SELECT composition, key, value, count(DISTINCT split) > 1 AS torn FROM e WHERE value IS NOT NULL GROUP BY ALL), l AS (SELECT composition, count(*) FILTER (WHERE torn) AS leaks FROM t GROUP BY composition)
            SELECT composition, missing, coalesce(leaks, 0) AS leaks, CASE WHEN missing > 0 THEN 'missing_data' WHEN leaks > 0 THEN 'failed' ELSE 'passed' END AS status FROM r LEFT JOIN l USING (composition)""",
        "speech_spans": """WITH t AS (SELECT take_id, regions, row_number() OVER (PARTITION BY take_id ORDER BY ingested_at DESC, regions DESC) AS k FROM takes WHERE regions IS NOT NULL),
            r AS (SELECT take_id, list_max(list_transform(regions, lambda r: r.end_sample)) AS total, list_filter(list_sort(list_distinct(list_transform(regions, lambda r: {'start': r.start_sample, 'end': r.end_sample}))), lambda r: r['end'] > r['start']) AS r FROM t WHERE k = 1),
            c AS (SELECT take_id, total, list_transform(flatten(list_transform(r, lambda x: list_transform(range(0, greatest((x['end'] - x['start'] - 1) // 240000, 0) + 1), lambda k: {'start': x['start'] + k * 240000, 'end': least(x['start'] + (k + 1) * 240000, x['end'])}))), lambda x: [x]) AS c FROM r),
            g AS (SELECT take_id, total, list_transform(list_reduce(c, lambda a, x: CASE WHEN x[1]['start'] - a[-1]['end'] > 9600 OR x[1]['end'] - a[-1]['start'] > 240000 OR a[-1]['end'] - a[-1]['start'] >= 128000 THEN list_concat(a, x)
                ELSE list_concat(a[1:len(a) - 1], [{'start': a[-1]['start'], 'end': x[1]['end']}]) END), lambda x: [x]) AS g FROM c WHERE len(c) > 0),
            m AS (SELECT take_id, total, unnest(list_reduce(g, lambda a, x: CASE WHEN x[1]['end'] - x[1]['start'] < 16000 AND x[1]['end'] - a[-1]['start'] <= 240000 AND x[1]['start'] - a[-1]['end'] <= 9600
                THEN list_concat(a[1:len(a) - 1], [{'start': a[-1]['start'], 'end': x[1]['end']}]) ELSE list_concat(a, x) END)) AS m FROM g)
            SELECT take_id, greatest(0, m['start'] - 1920) AS start, least(total, m['end'] + 1920) AS "end" FROM m""",
        "cut_takes": """WITH t AS (SELECT take_id, regions, row_number() OVER (PARTITION BY take_id ORDER BY ingested_at DESC, regions DESC) AS k FROM takes WHERE len(regions) > 0),
            w AS (SELECT take_id, list_max(list_transform(regions, lambda r: r.end_sample)) / 16000 AS total, list_transform(list_sort(list_distinct(list_transform(regions, lambda r: {'start': r.start_sample / 16000, 'end': r.end_sample / 16000}))), lambda x: [x]) AS w FROM t WHERE k = 1),
            g AS (SELECT take_id, total, list_reduce(w, lambda a, x: CASE WHEN x[1]['end'] - a[-1]['start'] > 15 OR a[-1]['end'] - a[-1]['start'] >= 8 OR x[1]['start'] - a[-1]['end'] > 1.2 THEN list_concat(a, x)
                ELSE list_concat(a[1:len(a) - 1], [{'start': a[-1]['start'], 'end': x[1]['end']}]) END) AS g FROM w),
            n AS (SELECT take_id, total, list_transform(range(1, len(g) + 1), lambda k: [{'s': g[k]['start'], 'e': g[k]['end'], 'a': CASE WHEN k < len(g) THEN g[k + 1]['start'] ELSE total END}]) AS n FROM g),
            c AS (SELECT take_id, list_reduce(list_concat([[{'s': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'a': 0.0::DOUBLE}]], n), lambda a, x: list_concat(a, [{'s': greatest(0, round_even(greatest(a[-1]['e'] / 16000, x[1]['s'] - 0.08::DOUBLE) * 16000, 0)),
                'e': least(round_even(total * 16000, 0), round_even(least(total, x[1]['e'] + 0.08::DOUBLE, (x[1]['e'] + x[1]['a']) / 2) * 16000, 0)), 'a': 0.0::DOUBLE}])) AS c FROM n)
            SELECT take_id, k - 2 AS chunk, CAST(c[k]['s'] AS BIGINT) AS start_sample, CAST(c[k]['e'] AS BIGINT) AS end_sample FROM (SELECT take_id, c, unnest(range(2, len(c) + 1)) AS k FROM c)""",
        "materialize_rows": f"""WITH r AS (SELECT id, CASE WHEN sentence IS NULL THEN 'decode' WHEN NOT octet_length(encode(sentence)) / 32000.0 BETWEEN 0.002 AND 0.008 THEN 'duration' WHEN {blank('text')} THEN 'empty_text' END AS reason, sha256(sentence) AS digest FROM utterances),
            f AS (SELECT id AS own, min(digest) AS first FROM r WHERE reason IS NULL GROUP BY id),
            t AS (SELECT id, coalesce(reason, CASE WHEN digest <> first THEN 'id_collision' END) AS reason, digest FROM r LEFT JOIN f ON id = own)
            SELECT DISTINCT id, NULL AS reason, digest AS pcm_sha256, 1::BIGINT AS rows FROM t WHERE reason IS NULL UNION ALL SELECT id, reason, NULL, count(*) FROM t WHERE reason IS NOT NULL GROUP BY id, reason""",
        "validation_checks": f"""WITH c AS (SELECT audio IS NOT NULL AS a, {evaluated('text')} <> '' AS t, duration BETWEEN 1 AND 16 AS d, NOT CAST(needs_review AS BOOLEAN) AS r, CAST(human_verified AS BOOLEAN) = {VERIFIED.format('speaker_id')} AS v,
                abs(original_end - original_start - duration) < 1e-6 AS s FROM utterances)
            SELECT unnest(['audio', 'text', 'duration', 'reviewed', 'verified', 'stretch']) AS "check", unnest([count(*) FILTER (WHERE NOT coalesce(a, false)), count(*) FILTER (WHERE NOT coalesce(t, false)), count(*) FILTER (WHERE NOT coalesce(d, false)),
                count(*) FILTER (WHERE NOT coalesce(r, false)), count(*) FILTER (WHERE NOT coalesce(v, false)), count(*) FILTER (WHERE NOT coalesce(s, false))]) AS violations FROM c""",
        "shared_split_keys": f"WITH {U} " + " UNION ALL ".join(f"SELECT '{k}' AS key, {k} AS value FROM u WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(DISTINCT split) > 1" for k in ("source_id", "pcm_sha256", "speaker_id")),
        "final_export": f"""WITH RECURSIVE {COMPONENTS},
            g AS (SELECT ordinal, source_id, speaker_id, pcm_sha256, {REASONS.format(f"CASE WHEN NOT coalesce(duration BETWEEN 1 AND 16, false) THEN 'duration_outside_1_16_seconds' END, CASE WHEN coalesce({evaluated('text')}, '') = '' THEN 'empty_normalized_text' END, CASE WHEN alignment_cer > 0.45 THEN 'alignment_cer_above_0.45' END")} AS reasons FROM utterances),
            k AS (SELECT *, reasons = '' AND (pcm_sha256 IS NULL OR row_number() OVER (PARTITION BY pcm_sha256, reasons = '' ORDER BY ordinal) = 1) AS kept FROM g),
            a AS (SELECT k.*, coalesce(component, source_id) AS split_group FROM k LEFT JOIN tied ON source_id = node WHERE kept),
            s AS (SELECT split_group, string_agg(DISTINCT coalesce(speaker_id, 'None'), '|' ORDER BY coalesce(speaker_id, 'None')) AS speakers FROM a GROUP BY split_group),
            r AS (SELECT *, row_number() OVER (PARTITION BY speakers ORDER BY sha256('42:' || split_group), split_group) AS place, count(*) OVER (PARTITION BY speakers) AS n FROM s),
            m AS (SELECT *, greatest(1, round_even(n * 0.1, 0)) AS m FROM r)
            SELECT ordinal, a.split_group, CASE WHEN n < 3 THEN 'train' WHEN place <= m THEN 'test' WHEN place <= 2 * m THEN 'validation' ELSE 'train' END AS split, reasons FROM a JOIN m USING (split_group)
            UNION ALL SELECT ordinal, NULL, NULL, CASE WHEN reasons = '' THEN 'duplicate_pcm' ELSE reasons END FROM k WHERE NOT kept""",
        "dataset_projection": "SELECT audio, sentence, speaker_id, source_id, chunk_id, CAST(NULL AS DOUBLE) AS start, CAST(NULL AS DOUBLE) AS \"end\", duration, asr_prediction, alignment_wer, alignment_method, CAST(human_verified AS BOOLEAN) AS human_verified FROM utterances",
        "pairs_two_tier": f"""WITH r AS (SELECT DISTINCT source, audio FROM recordings), same AS (SELECT DISTINCT {bare('audio')} AS b, {bare('audio')} || '.txt' AS path FROM r WHERE source IN ('mozilla', 'filimo')),
            t AS (SELECT path FROM same UNION SELECT 'texts/Text_' || {STEM.format('audio')} || '.srt' FROM r WHERE source IN ('elderly', 'ganjoor')),
            k AS (SELECT {key(STEM.format('path'))} AS key, count(DISTINCT path) AS n, min(path) AS path FROM t GROUP BY 1),
            j AS (SELECT audio, same.path AS own, k.path AS other, CASE WHEN same.path IS NOT NULL THEN 1 ELSE coalesce(k.n, 0) END AS n FROM (SELECT DISTINCT audio FROM r) LEFT JOIN same ON {bare('audio')} = b LEFT JOIN k ON {key(STEM.format('audio'))} = key)
            SELECT audio, CASE WHEN n = 1 THEN coalesce(own, other) END AS text, CASE WHEN n <> 1 THEN n || ' matching texts' END AS problem FROM j""",
        "path_candidates": """WITH u AS (SELECT ordinal, audio, 'portable/' || regexp_extract(audio, '[^/]*$') AS p, CAST(human_verified AS BOOLEAN) AS v, CAST(needs_review AS BOOLEAN) AS n FROM utterances),
            f AS (SELECT p AS path FROM u WHERE v UNION SELECT audio FROM u WHERE n)
            SELECT ordinal, CASE WHEN p IN (SELECT path FROM f) THEN p WHEN audio IN (SELECT path FROM f) THEN audio ELSE p END AS found FROM u""",
        "valid_items": f"SELECT ordinal FROM utterances WHERE duration > 2 AND duration <= 10 AND length({standard('sentence')}) > 5",
        "chat_prefixes": f"SELECT ordinal, '<|im_start|>system' || chr(10) || coalesce(source, '') || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<|audio_start|><|audio_pad|><|audio_end|><|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || 'language ' || {named} || '<asr_text>' AS prefix FROM utterances",
        "percent_slice": "SELECT ordinal FROM utterances WHERE ordinal - (SELECT min(ordinal) FROM utterances) < round_even((SELECT count(*) FROM utterances) * 0.9, 0)",
        "ctc_feasible_counts": f"""WITH {U}, l AS (SELECT split, {label} AS label, round_even(CASE WHEN duration > 0 THEN duration ELSE 0 END * 16000, 0) AS n FROM u), c AS (SELECT *, list_filter(string_split(label, ''), lambda x: x <> '') AS c FROM l),
            f AS (SELECT split, CASE WHEN len(c) > 0 THEN greatest(10, len(c) + coalesce(list_sum(list_transform(range(1, len(c)), lambda k: CASE WHEN c[k] = c[k + 1] THEN 1 ELSE 0 END)), 0)) ELSE 0 END AS needed, {frames("n")} AS available FROM c),
            g AS (SELECT split, needed, coalesce(needed > 0 AND needed <= available, false) AS ok FROM f)
            SELECT split, count(*) AS before, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS excluded, count(*) FILTER (WHERE needed = 0) AS empty FROM g GROUP BY split""",
        "split_speakers": f"WITH {U} SELECT split, sha256(coalesce(string_agg(DISTINCT speaker_id, '|' ORDER BY speaker_id), '')) AS speakers, count(DISTINCT speaker_id) AS n FROM u GROUP BY split",
        "noise_audit": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at, ordinal) AS a, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, ordinal DESC) AS z FROM utterances WHERE source = 'seniortalk' AND id IS NOT NULL),
            j AS (SELECT o.id, o.text IS DISTINCT FROM n.text OR o.source_id IS DISTINCT FROM n.source_id OR o.pcm_sha256 IS DISTINCT FROM n.pcm_sha256 AS changed FROM f o JOIN f n ON o.id = n.id AND o.a = 1 AND n.z = 1)
            SELECT unnest(['snr20', 'snr10', 'snr5', 'rir', 'channel', 'combined']) AS condition, count(*) AS samples, 0::BIGINT AS missing, 0::BIGINT AS unknown, count(*) FILTER (WHERE changed) AS changed FROM j""",
        "augmentation_plan": f"""WITH {U} SELECT ordinal, split = 'train' AS apply_augmentation, CASE WHEN split = 'train' AND {drawn('any')} < 0.5
            THEN array_to_string(list_filter([{', '.join(f"CASE WHEN {drawn(g)} < {chance[g]} THEN '{g}' END" for g in left)}], lambda x: x IS NOT NULL), ',') ELSE '' END AS augmentation FROM u WHERE id IS NOT NULL""",
        "eval_suites": """WITH u AS (SELECT source, CASE WHEN duration > 0 THEN duration END AS d, asr_prediction, ordinal > min(ordinal) OVER (PARTITION BY id) AS cached FROM utterances WHERE id IS NOT NULL)
            SELECT source, count(*) AS samples, count(*) FILTER (WHERE asr_prediction IS NULL) AS failures, count(*) FILTER (WHERE cached) AS reused_predictions, CASE WHEN NOT bool_or(cached) THEN round(sum(d * 0.1) / sum(d), 6) END AS real_time_factor FROM u GROUP BY source""",
        "volume_stats": " UNION ALL ".join(volumes),
        "mean_confidence": "SELECT vec_id, round(list_avg(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) + 0.0 AS confidence FROM embeddings",
        "unknown_recordings": f"WITH {U} SELECT DISTINCT source_id FROM u WHERE split = 'test' AND source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM recordings WHERE source_id IS NOT NULL)",
        "page_blocks": f"""WITH l AS (SELECT doc_id, unnest(string_split({gsub('text', odd, '')}, chr(10))) AS line, generate_subscripts(string_split({gsub('text', odd, '')}, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
            s AS (SELECT doc_id, k, {gsub('line', f'^{WS}+|{WS}+$', '')} AS line FROM l)
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS verse, sha256(line) AS digest FROM s WHERE line <> ''""",
        "substring_offsets": """WITH p AS (SELECT source_id, chunk_id, coalesce(min(text), '') AS text, min(text) AS raw, min(sentence) AS sentence FROM utterances WHERE chunk_id IS NOT NULL GROUP BY ALL),
            w AS (SELECT source_id, string_agg(text, ' ' ORDER BY chunk_id) AS whole FROM p GROUP BY source_id), h AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) AS k FROM p)
            SELECT h.source_id, chunk_id FROM h LEFT JOIN w ON h.source_id = w.source_id WHERE k = 1 AND (whole IS NULL OR substr(whole, 1, length(text)) IS DISTINCT FROM sentence)""",
        "prompt_places": "SELECT ordinal FROM utterances WHERE text IS NULL OR sentence IS DISTINCT FROM text",
        "aligned_lines": """WITH l AS (SELECT l_orderkey, l_linenumber AS place, min(CAST(l_partkey AS VARCHAR)) AS text, max(l_quantity) AS q FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, count(*) - 1 AS texts, max(place) AS last, count(*) FILTER (WHERE q > 10) AS chunks FROM l GROUP BY l_orderkey)
            SELECT l.l_orderkey, place, CASE WHEN place < last THEN text END AS text, CASE WHEN q > 10 THEN 'chunk_' || place END AS audio, CASE WHEN texts <> chunks THEN texts || ' texts, ' || chunks || ' chunks' END AS problem FROM l JOIN s USING (l_orderkey) WHERE place < last OR q > 10""",
    }


def oracle_sql() -> dict[str, str]:
    return {
        **more_sql(),
        "manifest_training": "SELECT audio, text, coalesce(nullif(language, ''), 'Persian') AS language, '' AS prompt, coalesce(duration, 0.0) AS duration FROM utterances WHERE text IS NOT NULL",
        "latest_delivery": "SELECT id, ingested_at, ordinal FROM (SELECT id, ingested_at, ordinal, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, ordinal DESC) AS k FROM utterances) WHERE k = 1",
        "prompt_text": "SELECT ordinal, language, 'language ' || language || '<asr_text>' || text AS text FROM utterances",
        "plain_labels": f"WITH l AS (SELECT ordinal, 'language ' || language || '<asr_text>' || text AS text FROM utterances) SELECT ordinal, {plain('text')} AS plain, {after('text')} AS after FROM l",
        "reform_text": f"SELECT ordinal, {reform('sentence')} AS reformed FROM utterances",
        "standard_text": f"SELECT ordinal, {standard('sentence')} AS standard FROM utterances",
        "norm_ctc": f"SELECT doc_id, {ctc('text')} AS form FROM documents",
        "norm_eval_composed": f"SELECT ordinal, {evaluated('sentence')} AS form FROM utterances",
        "norm_chunk_composed": f"SELECT DISTINCT take_id, {squeeze(gsub(translated('sentence', text.FOLDED, text.FOLDED_TO), '[^0-9A-Za-z' + chr(0x600) + '-' + chr(0x6FF) + ']+'))} AS form FROM takes",
        "safe_ids": f"""SELECT DISTINCT source_id, coalesce(nullif({gsub(gsub(squeeze('source_id'), '[^0-9A-Za-z' + chr(0x600) + '-' + chr(0x6FF) + '_-]+', '_'), '^_+|_+$', '')}, ''), 'recording') AS safe,
            regexp_replace(regexp_extract(audio, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem, 'portable/' || regexp_extract(audio, '[^/]*$') AS moved FROM recordings""",
        "group_split_bucket": """SELECT source_id, b AS bucket, CASE WHEN b < 10 THEN 'test' WHEN b < 20 THEN 'validation' ELSE 'train' END AS split
            FROM (SELECT source_id, ('0x' || substr(sha256('42:' || source_id), 1, 12))::BIGINT % 100 AS b FROM (SELECT DISTINCT source_id FROM utterances))""",
        "promote_split": f"WITH {PROMOTED} SELECT ordinal, source_id, original_split, split FROM promoted",
        "keep_first_dedup": f"WITH {KEPT} SELECT ordinal, id, split, kept FROM kept",
        "publish_stats": f"WITH {KEPT} {STATS}",
        "first_reason": f"WITH {U} SELECT ordinal, CASE WHEN NOT coalesce(duration BETWEEN 1 AND 20, false) THEN 'duration' WHEN {blank('text')} THEN 'empty_text' END AS reason FROM u",
        "all_reasons": "SELECT ordinal, " + REASONS.format(f"""CASE WHEN NOT coalesce(duration BETWEEN 1 AND 16, false) THEN 'duration_outside_1_16_seconds' END,
            CASE WHEN coalesce({evaluated('text')}, '') = '' THEN 'empty_normalized_text' END,
            CASE WHEN {gsub(ctc('text'), '[' + text.STANDARD_LETTERS + ' ]', '')} <> '' THEN 'unsupported_alignment_character' END, CASE WHEN alignment_cer > 0.45 THEN 'alignment_cer_above_0.45' END,
            CASE WHEN lower(pcm_sha256) = sha256('') THEN 'silent_audio' END""") + " AS reasons FROM utterances",
        "quality_gate": "SELECT ordinal, " + reasons(
            duration="NOT coalesce(duration BETWEEN 1 AND 20, false)",
            alignment_wer="NOT coalesce(CAST(human_verified AS BOOLEAN), false) AND (alignment_wer IS NULL OR alignment_wer > 0.55)",
            needs_review="NOT coalesce(CAST(human_verified AS BOOLEAN), false) AND coalesce(needs_review, false)", empty_text=blank("sentence"),
        ) + " AS reasons FROM utterances",
        "apply_reviews": f"""WITH r AS (
                SELECT chunk, sentence FROM (SELECT {squeeze('chunk_id')} AS chunk, {squeeze('sentence')} AS sentence, row_number() OVER (PARTITION BY {squeeze('chunk_id')} ORDER BY reviewed_at DESC, {squeeze('sentence')} DESC) AS k FROM reviews WHERE {APPROVED_SQL}) WHERE k = 1
            ) SELECT ordinal, chunk_id, CASE WHEN chunk IS NOT NULL THEN r.sentence ELSE u.sentence END AS sentence, CASE WHEN chunk IS NOT NULL THEN false ELSE needs_review END AS needs_review,
                CASE WHEN chunk IS NOT NULL THEN true ELSE human_verified END AS human_verified FROM utterances u LEFT JOIN r ON chunk_id = chunk""",
        "review_errors": f"""WITH r AS (SELECT {squeeze('chunk_id')} AS chunk_id, sentence FROM reviews WHERE {APPROVED_SQL})
            SELECT DISTINCT chunk_id, 'unknown chunk_id' AS problem FROM r WHERE chunk_id NOT IN (SELECT chunk_id FROM utterances WHERE chunk_id IS NOT NULL)
            UNION SELECT chunk_id, 'approved text is empty' FROM r WHERE {blank('sentence')}""",
        "leak_pairs": f"WITH {U} {LEAKS}",
        "leaked_sources": f"WITH {U} SELECT source_id, count(DISTINCT split) AS splits FROM u WHERE source_id IS NOT NULL GROUP BY source_id HAVING count(DISTINCT split) > 1",
        "duplicate_ids": "SELECT id, count(*) AS times FROM utterances GROUP BY id HAVING count(*) > 1",
        "recording_components": """WITH RECURSIVE e AS (
                SELECT DISTINCT source_id AS node, unnest(['audio:' || audio_sha256, 'text:' || text_sha256]) AS key FROM recordings
            ), links AS (SELECT DISTINCT a.node AS a, b.node AS b FROM (SELECT * FROM e WHERE key IS NOT NULL AND node IS NOT NULL) a JOIN e b USING (key)),
            reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
            SELECT node, min(other) AS component FROM reach GROUP BY node""",
        "rank_split": f"""WITH {U}, n AS (SELECT name, row_number() OVER (ORDER BY sha256('42:' || name), name) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT coalesce(speaker_id, 'None') AS name FROM u)),
            t AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.1, 0)) ELSE round_even(n * 0.1, 0) END AS t FROM n),
            v AS (SELECT *, greatest(0, least(CASE WHEN n - t >= 2 THEN greatest(1, round_even(n * 0.1, 0)) ELSE round_even(n * 0.1, 0) END, n - t - 1)) AS v FROM t)
            SELECT ordinal, speaker_id, CASE WHEN k <= t THEN 'test' WHEN k <= t + v THEN 'validation' ELSE 'train' END AS split FROM u JOIN v ON coalesce(speaker_id, 'None') = name""",
        "strata_split": """WITH g AS (SELECT source_id, string_agg(DISTINCT speaker_id, '|' ORDER BY speaker_id) AS speakers FROM recordings WHERE speaker_id IS NOT NULL GROUP BY source_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY speakers ORDER BY sha256('42:' || source_id), source_id) AS k, count(*) OVER (PARTITION BY speakers) AS n FROM g),
            m AS (SELECT *, greatest(1, round_even(n * 0.1, 0)) AS m FROM r)
            SELECT source_id, speakers, CASE WHEN n < 3 THEN 'train' WHEN k <= m THEN 'test' WHEN k <= 2 * m THEN 'validation' ELSE 'train' END AS split FROM m""",
        "volumes": " UNION ALL ".join(volume(n, s) for n, s in (("025", 0.25), ("050", 0.5), ("075", 0.75))),
        "asset_holdout": """SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY sha256(p_name), p_name) AS k, count(*) OVER () AS n FROM (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name)) WHERE k <= greatest(1, round_even(n * 0.2, 0))""",
        "matched_sample": """WITH s AS (SELECT source, count(*) AS n FROM (SELECT DISTINCT id, source, needs_review FROM utterances) WHERE needs_review GROUP BY source),
            r AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || id), id) AS k FROM (SELECT DISTINCT id, source FROM utterances))
            SELECT id, source FROM r JOIN s USING (source) WHERE k <= n""",
        "compose_public": composed(f"SELECT * FROM u WHERE source IN ({', '.join(map(q, COMPOSITIONS['public']))})"),
        "composition_readiness": f"""WITH c(composition, source) AS (VALUES {COMPOSED}), h AS (SELECT DISTINCT source FROM utterances)
            SELECT composition, count(*) AS sources, coalesce(string_agg(CASE WHEN h.source IS NULL THEN c.source END, ',' ORDER BY c.source), '') AS missing, count(h.source) = count(*) AS ready
            FROM c LEFT JOIN h ON c.source = h.source GROUP BY composition""",
        "wer_rows": f"WITH {SCORED} SELECT ordinal, word_errors, words, char_errors, chars FROM errors",
        "wer_cer_corpus": f"WITH {SCORED} {RATES}",
        "wer_raw_corpus": f"WITH {scored(plain)} {RATES}",
        "high_wer": f"WITH {SCORED} SELECT ordinal, word_errors, words FROM errors WHERE word_errors > 0.4 * words",
        "teacher_filter": f"""WITH {SCORED}, a AS (SELECT source, coalesce(word_errors / nullif(words, 0) < 0.2, false) AS ok FROM errors)
            SELECT source, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected FROM a GROUP BY source""",
        "sessions_greedy": """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, epoch_us(ts) / 3.6e9 AS s FROM events),
            r AS (SELECT user_id, k, s AS head, s + 0.25 AS tail, 0 AS session FROM e WHERE k = 1
                UNION ALL SELECT user_id, k, CASE WHEN new THEN s ELSE head END, s + 0.25, session + CASE WHEN new THEN 1 ELSE 0 END
                FROM (SELECT e.user_id, e.k, e.s, r.head, r.session, (e.s + 0.25 - r.head > 15 OR r.tail - r.head >= 8 OR e.s - r.tail > 1.2) AS new FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
            SELECT user_id, count(*) AS sessions, max(n) AS most_items FROM (SELECT user_id, session, count(*) AS n FROM r GROUP BY ALL) GROUP BY user_id""",
        "fixed_windows": """SELECT take_id, n, CAST(s AS BIGINT) AS start, CAST(least(s + 256000, n) AS BIGINT) AS "end" FROM (
            SELECT take_id, n, unnest(range(0, n, 256000)) AS s FROM (SELECT DISTINCT take_id, CAST(floor(duration * 16000) AS BIGINT) AS n FROM takes WHERE duration > 0))""",
        "context_windows": """SELECT take_id, n, CAST(greatest(s - 100, 0) AS BIGINT) AS start, CAST(least(s + 1100, n) AS BIGINT) AS "end", CAST(s AS BIGINT) AS core_start, CAST(least(s + 1000, n) AS BIGINT) AS core_end FROM (
            SELECT take_id, n, unnest(range(0, n, 1000)) AS s FROM (SELECT DISTINCT take_id, CAST(floor(duration * 50) AS BIGINT) AS n FROM takes WHERE duration > 0))""",
        "region_pairs": """WITH t AS (SELECT DISTINCT take_id, list_sort(list_distinct(list_transform(regions, lambda r: r.start_sample))) AS s FROM takes WHERE regions IS NOT NULL)
            SELECT DISTINCT take_id, s[k] AS start, s[k + 1] AS "end" FROM (SELECT take_id, s, unnest(range(1, len(s))) AS k FROM t)""",
        "overlap_check": """WITH r AS (SELECT source_id, id, min(original_start) AS start, min(original_end) AS "end" FROM utterances WHERE original_start IS NOT NULL GROUP BY ALL),
            n AS (SELECT *, lead(start) OVER (PARTITION BY source_id ORDER BY start, id) AS next_start FROM r) SELECT source_id, id, "end", next_start FROM n WHERE "end" > next_start + 1e-6""",
        "proportional_bounds": """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS w FROM lineitem GROUP BY ALL),
            b AS (SELECT *, sum(w) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS c, sum(w) OVER (PARTITION BY l_orderkey) AS t, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM l),
            e AS (SELECT *, CAST(CASE WHEN l_linenumber = last THEN 100 ELSE round_even(100 * c / t, 0) END AS BIGINT) AS to_word FROM b)
            SELECT l_orderkey, l_linenumber, coalesce(lag(to_word) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS from_word, to_word FROM e""",
        "vocabulary_by_language": """WITH c AS (SELECT DISTINCT coalesce(language, '?') AS language, unnest(string_split(text, '')) AS character FROM utterances WHERE text IS NOT NULL)
            SELECT language, character, row_number() OVER (PARTITION BY language ORDER BY character) - 1 AS number FROM c WHERE character <> ''""",
        "ctc_feasible": f"""WITH l AS (SELECT ordinal, {ctc("coalesce(text, '')")} AS label, round_even(CASE WHEN duration > 0 THEN duration ELSE 0 END * 16000, 0) AS n FROM utterances),
            c AS (SELECT *, list_filter(string_split(label, ''), lambda x: x <> '') AS c FROM l),
            f AS (SELECT ordinal, label, CAST(len(c) + coalesce(list_sum(list_transform(range(1, len(c)), lambda k: CASE WHEN c[k] = c[k + 1] THEN 1 ELSE 0 END)), 0) AS BIGINT) AS needed, {frames("n")} AS available FROM c)
            SELECT ordinal, needed, available, label <> '' AND needed <= available AS feasible FROM f""",
        "ctc_greedy_decode": """WITH f AS (SELECT vec_id, list_transform(range(0, CAST(len(embedding) / 8 AS BIGINT)), lambda k: list_slice(embedding, k * 8 + 1, k * 8 + 8)) AS f FROM embeddings),
            b AS (SELECT vec_id, list_transform(f, lambda x: list_position(x, list_max(x)) - 1) AS b FROM f)
            SELECT vec_id, array_to_string(list_filter(list_transform(range(1, len(b) + 1), lambda k: CASE WHEN k = 1 OR b[k] <> b[k - 1] THEN b[k] ELSE 0 END), lambda x: x <> 0), ',') AS symbols FROM b""",
        "signal_levels": """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)
            SELECT vec_id, round(list_sum(list_transform(x, lambda v: v * v)), 4) AS energy, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 4) AS rms, round(list_max(list_transform(x, lambda v: abs(v))), 4) AS peak FROM x""",
        "zipped_lines": "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_partkey AS next_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1",
        "partition_complete": """WITH c AS (SELECT source_id, chunk_id, coalesce(min(text), '') AS text FROM utterances WHERE chunk_id IS NOT NULL GROUP BY ALL),
            j AS (SELECT source_id, string_agg(text, ' ' ORDER BY chunk_id) AS joined FROM c GROUP BY source_id) SELECT source_id, CAST(length(joined) AS BIGINT) AS chars, sha256(joined) AS digest FROM j""",
        "merge_increment": """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' UNION ALL
            SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
        "increment_conflicts": "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'",
        "status_zero_fill": "SELECT s AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS jobs FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s)",
        "runnable_jobs": f"""WITH j(id, status, priority, dependencies) AS (VALUES {JOB_VALUES})
            SELECT id, priority FROM j WHERE status = 'pending' AND id NOT IN (
                SELECT id FROM (SELECT id, unnest(dependencies) AS d FROM j) WHERE d NOT IN (SELECT id FROM j WHERE status = 'complete'))""",
        "noise_plan": """WITH r AS (SELECT id, unnest(['snr20', 'snr10', 'snr5', 'rir', 'channel', 'combined']) AS condition FROM (SELECT DISTINCT id FROM utterances WHERE source = 'seniortalk')),
            s AS (SELECT id, condition, ('0x' || substr(sha256(id || ':' || condition || ':42'), 1, 8))::BIGINT AS seed FROM r)
            SELECT id, condition, seed, CASE condition WHEN 'snr20' THEN 20 WHEN 'snr10' THEN 10 WHEN 'snr5' THEN 5 WHEN 'combined' THEN 10 END AS snr,
                CASE WHEN condition IN ('snr20', 'snr10', 'snr5', 'combined') THEN seed % 37 END AS background, CASE WHEN condition IN ('rir', 'combined') THEN seed % 11 END AS room FROM s""",
        "prediction_cache": "WITH n AS (SELECT audio, language, count(*) AS n FROM utterances GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS requests, count(*) AS predicted, CAST(sum(n) - count(*) AS BIGINT) AS reused FROM n",
        "equal_sets": """WITH a AS (SELECT source_id, min(source) AS s FROM utterances GROUP BY source_id), b AS (SELECT source_id, min(source) AS s FROM recordings GROUP BY source_id)
            SELECT count(*) FILTER (WHERE b.source_id IS NULL) AS left_only, count(*) FILTER (WHERE a.source_id IS NULL) AS right_only, count(*) FILTER (WHERE a.source_id IS NOT NULL AND b.source_id IS NOT NULL AND a.s IS DISTINCT FROM b.s) AS differ
            FROM a FULL JOIN b ON a.source_id = b.source_id""",
        "processing_summary": f"WITH {U} SELECT split, count(*) AS samples, round(sum(duration) / 3600, 4) AS hours, count(DISTINCT source_id) AS sources, count(DISTINCT speaker_id) AS speakers FROM u GROUP BY split",
        "unreferenced_recordings": "SELECT DISTINCT source_id FROM recordings WHERE source_id NOT IN (SELECT source_id FROM utterances WHERE source_id IS NOT NULL)",
        "delivery_days": "SELECT date_trunc('day', ingested_at) AS day, source, count(*) AS rows, CAST(round(sum(duration) * 10000) AS BIGINT) AS seconds_e4 FROM utterances GROUP BY ALL",
    }
