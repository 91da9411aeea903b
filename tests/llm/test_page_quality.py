"""List pages: planted kinds, near misses and hosts of phrases."""

import random

import pytest

from utterlake.llm.page_quality import list_pages

FA = "معمولاً مادربزرگ با دوستان در باغ شعر می‌خواند و همیشه از پنجره به کوچه نگاه می‌کرد."
EN = "The old doctor carefully opened the window of the garden and the young shepherd looked at a distant village."
ZH = "那一年布鞋打扫熟悉的照片后来板凳收拾旧的枕头和集市。"
LISTS = {
    "tags": "#خرید_عینک#فروش_سمعک#قیمت_گلیم#دانلود_آهنگ#لیست_دارو#تعمیر_بخاری" * 3,
    "wide tags": "＃خرید＿عینک＃فروش＿سمعک＃قیمت＿گلیم＃دانلود＿آهنگ＃لیست＿دارو" * 3,
    "lines": "\n".join(f"دانلود فیلم شماره {k} HD" for k in "abcdefghij"),
    "products": " | ".join(f"هدفون Noravin-{k}52 61000" for k in range(12)),
    "words": "speaker headphones cheap speaker speaker price headphones speaker " * 8,
    "phrases": "خرید دارو دیلیستان ارزان خرید دارو تهران، خرید دارو قم. " * 8,
    "links": " ".join(f"[best carpet](http://shop{k}.example/p/{k})" for k in range(9)),
    "html": "\n".join(f'<a href="http://a{k}.test/x">تعمیر فیلم</a>' for k in range(9)),
    "han": "便宜老花镜 » 优惠拐杖 » 购买麦克风 » 批发麦克风 » 下载音箱 » 便宜录音笔 » 特价拐杖雨伞",
    "mixed": FA + "\n" + "#خرید_عینک #فروش_سمعک #قیمت_گلیم #دانلود_آهنگ " * 6,
}
PAGES = {
    "prose": f"{FA} {EN}\n{ZH}" * 4,
    "verse": "\n".join(f"{x} نگار من نگار من" for x in ("در باغ بهار با تو می‌خندیدم ای", "از کوه بلند به خانه برگشتیم ما", "با باد صبا شعر تازه می‌خواندم ای") * 3),
    "ends in tags": FA * 6 + "\n#عینک #سمعک #گلیم #آهنگ https://a.example/1",
    "goods": "The shop on the corner sells a carpet and the owner repairs a kettle with old tools for the village. " * 5,
    "subtitles": "\n\n".join(f"{k}\n00:00:{k:02d},000 --> 00:00:{k + 1:02d},000\nبله، {FA}" for k in range(10)),
    "short": "سلام",
}


@pytest.mark.parametrize("name", LISTS)
def test_lists(spark, name):
    assert list_pages(spark.createDataFrame([(1, LISTS[name], "s")], "doc_id bigint, text string, source string")).count() == 1


@pytest.mark.parametrize("name", PAGES)
def test_pages(spark, name):
    assert list_pages(spark.createDataFrame([(1, PAGES[name], "s")], "doc_id bigint, text string, source string")).count() == 0


def test_hosts_carry_a_page(spark):
    # Three short phrases are no run; they count once they stand on three hosts.
    page = "خرید عینک ارزان\nفروش سمعک تازه\nقیمت گلیم قدیمی"
    rows = lambda hosts: [(k, page, h) for k, h in enumerate(hosts)]
    schema = "doc_id bigint, text string, source string"
    assert list_pages(spark.createDataFrame(rows(["a", "b", None, "a"]), schema)).count() == 0
    assert list_pages(spark.createDataFrame(rows(["a", "b", "c", None]), schema)).count() == 4


def test_edges(spark):
    schema = "doc_id bigint, text string, source string, host string, chars int"
    rows = [(1, None, "s", "x", 1), (2, "", "s", "x", 1), (3, " \n", "s", "x", 1), (4, LISTS["tags"], None, "x", 1), (4, LISTS["tags"], None, "x", 1), (5, LISTS["words"] * 3000, "s", "x", 1), (6, EN * 5000, "s", "x", 1)]
    got = {r.doc_id: r.list_share for r in list_pages(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {4, 5} and all(0.5 < v <= 1 for v in got.values())
    assert list_pages(spark.createDataFrame([], schema)).count() == 0


def keyword_page(seed, words=90):
    """Keywords of a small vocabulary and names of their own, with blanks only."""
    pick = random.Random(seed)
    kinds, goods = "price cheap buy sale review online discount wholesale offer top".split(), "kettle carpet blanket recorder speaker amplifier microphone earplug cassette saffron".split()
    name = lambda: "".join(pick.choice("bdfgklmnprstvz") + pick.choice("aeiou") for _ in range(4))
    return " ".join(f"{pick.choice(kinds)} {pick.choice(goods)} {name()}" for _ in range(words // 3))


def han_page(seed, sentences=60):
    """Chinese sentences of few words."""
    pick = random.Random(seed)
    things, deeds, kinds = "布鞋 照片 板凳 枕头 集市 果园 铁匠 茶馆 灯笼 日历 核桃 小桥".split(), "打扫 收拾 记得 画过 找到 寄出 唱起 借来".split(), "熟悉 旧 远处 红色 温暖 白色".split()
    return "".join(f"{pick.choice(things)}{pick.choice(deeds)}{pick.choice(kinds)}的{pick.choice(things)}和{pick.choice(things)}。" for _ in range(sentences))


def test_keywords_without_separators(spark):
    # Keywords come back far apart, between words that stand only once.
    rows = [(k, keyword_page(k), "s") for k in range(5)] + [(10, "\n".join(PAGES.values()), "s"), (11, han_page(3), "s")]
    got = list_pages(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert {r.doc_id for r in got} == set(range(5))


def test_shingles_of_hosts_carry_a_page(spark):
    # No word comes back on its page and there is no separator: only other hosts tell that the pairs are key phrases.
    pick = random.Random(9)
    word = lambda: "".join(pick.choice("bdfgklmnprstvz") + pick.choice("aeiou") for _ in range(5))
    pairs = [f"{word()} {word()}" for _ in range(30)]
    mixed = lambda: " ".join(f"{p} {word()}" for p in pick.sample(pairs, len(pairs)))
    schema = "doc_id bigint, text string, source string"
    rows = [(k, mixed(), h) for k, h in enumerate(["a", "b", None, "a"])]
    prose = [(10 + k, PAGES["prose"], h) for k, h in enumerate("abcd")]
    assert list_pages(spark.createDataFrame(rows + prose, schema)).count() == 0
    got = list_pages(spark.createDataFrame(rows + prose + [(4, mixed(), "c")], schema)).collect()
    assert {r.doc_id for r in got} == set(range(5)) and all(0.5 < r.list_share < 0.9 for r in got)
    # Hosts count in sentences too, and one stretch of two overlapping units counts once.
    told = [(20 + k, f"The {p} stood on a hill and in the valley.", h) for p in pairs for k, h in enumerate("bc")]
    got = list_pages(spark.createDataFrame([rows[0], *told], schema)).collect()
    assert {r.doc_id for r in got} == {0}


def test_hosts_prove_a_list(spark):
    # Titles that stand once on their page: on one page among several hosts nothing proves them, on two hosts they do.
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("bdfgklmnprstvz") + pick.choice("aeiou") for _ in range(5))
    titles = [f"{word()} {word()} {word()}" for _ in range(24)]
    schema = "doc_id bigint, text string, source string"
    prose = [(10, PAGES["prose"], "a"), (11, PAGES["goods"], "b")]
    one = (1, "\n".join(titles), "a")
    assert list_pages(spark.createDataFrame([one, *prose], schema)).count() == 0
    # A copy of the page on its own host is no other host; the titles in another order on another host are.
    assert list_pages(spark.createDataFrame([one, (2, one[1], "a"), (3, one[1], None), *prose], schema)).count() == 0
    got = list_pages(spark.createDataFrame([one, (2, "\n".join(titles[::-1]), "b"), *prose], schema)).collect()
    assert {r.doc_id for r in got} == {1, 2}
    # Sentences copied from other hosts are replicated, but no list.
    told = [f"The {word()} of the {word()} stood on a {word()} in the {word()} and the {word()} went to a {word()}." for _ in range(30)]
    rows = [(20 + k, " ".join(pick.sample(told, 20)), h) for k, h in enumerate("abcd")]
    assert list_pages(spark.createDataFrame(rows, schema)).count() == 0
