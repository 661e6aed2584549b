import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.llm import names


def rows():
    a = [("荻塘证券", "眭霖琰,澹台澈琮"), ("荻塘证券", "眭霖琰"), ("荻塘证券股份有限公司", "眭 霖琰、澹台澈琮(首席)"), ("Ditagn Securities", "Sui Linyan"), ("Di tang Sec.", "L.Y. Sui;Tantai Checong")]
    b = [("荻塘期货", "眭朔棠"), ("期货(荻塘)", "眭朔棠 CFA，朔棠老师"), ("DITANG FUTURES", "SUI SHUOTANG")]
    c = [("Pellwick Partners", "Nai Heqi"), ("Pellwick Partners", "佴禾祺"), ("Pelwick Partners", "佴禾祺"), ("Pellwick", "禾祺佴"), ("The Pellwick Partners Ltd", "佴小禾")]
    return a + b + c + [(None, "乜岚祺"), ("　", None), ("荻塘证券", ""), (None, None), ("荻塘", "眭霖琰")]


def test_variants(spark):
    df = spark.createDataFrame(rows() * 2, "ORGAN_NAME string, AUTHOR_NAME string")
    groups = {}
    for r in names.name_entities(df).collect():
        groups.setdefault((r.field, r.entity), set()).add(r.name)
    orgs = {frozenset(v) for (f, _), v in groups.items() if f == "ORGAN_NAME"}
    assert orgs == {
        frozenset({"荻塘证券", "荻塘证券股份有限公司", "Ditagn Securities", "Di tang Sec.", "荻塘"}),
        frozenset({"荻塘期货", "期货(荻塘)", "DITANG FUTURES"}),
        frozenset({"Pellwick Partners", "Pelwick Partners", "Pellwick", "The Pellwick Partners Ltd"}),
    }
    people = {frozenset(v) for (f, _), v in groups.items() if f == "AUTHOR_NAME"}
    assert people == {
        frozenset({"眭霖琰", "眭 霖琰", "Sui Linyan", "L.Y. Sui"}),
        frozenset({"澹台澈琮", "澹台澈琮(首席)", "Tantai Checong"}),
        frozenset({"眭朔棠", "眭朔棠 CFA", "朔棠老师", "SUI SHUOTANG"}),
        frozenset({"Nai Heqi", "佴禾祺", "禾祺佴", "佴小禾"}),
        frozenset({"乜岚祺"}),
    }
    pairs = names.variant_pairs(names.name_entities(df)).collect()
    assert len(pairs) == sum(len(v) * (len(v) - 1) // 2 for v in [*orgs, *people])
    assert all(p.name_a < p.name_b for p in pairs)


def test_empty(spark):
    assert names.name_entities(spark.createDataFrame([], "ORGAN_NAME string, AUTHOR_NAME string")).count() == 0


def distance(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_one_edit_and_neighbourhoods(a, b):
    assert names.one_edit(a, b) == (distance(a, b) <= 1)
    if distance(a, b) <= 1 and min(len(a), len(b)) > 2:
        swapped = len(a) == len(b) and a != b
        assert names.left_out(a) >= {names._whole([ord(c) for c in a[:k] + a[k + 1 :]]) for k in range(len(a)) if len(a) > 2}
        assert names.left_out(a) & names.left_out(b) or swapped


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["chi", "chu", "lin", "l", "xu", "xun"]), min_size=1, max_size=4), st.lists(st.sampled_from(["chi", "lin", "lim", "x", "xu"]), min_size=1, max_size=4))
def test_assignment_is_optimal(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = min(sum(map(names.token_price, short, p)) for p in itertools.permutations(long, len(short))) + 0.5 * (len(long) - len(short))
    assert abs(names.assignment_price(a, b) - best) < 1e-9


def test_texts_in_place_of_names(spark):
    long = [("机构" * 5000, "字" * 5000), ("word " * 300, "Some Words " * 200), ("a" * 3000, "b" * 3000), ("荻塘证券", "眭霖琰")]
    df = spark.createDataFrame(long, "ORGAN_NAME string, AUTHOR_NAME string").withColumn("name", F.lit("x")).withColumn("entity", F.lit("x"))
    got = names.name_entities(df).collect()
    assert len(got) == 8 and len({(r.field, r.entity) for r in got}) == 8


def groups_of(entities):
    found = {}
    for r in entities.collect():
        found.setdefault((r.field, r.entity), set()).add(r.name)
    return {frozenset(v) for v in found.values()}


def test_ordinary_names(spark):
    rows = [("东方财富证券", "王强,王 强")] * 3 + [("东方财富证券", "王强（实习）"), ("东方财富证券", "Wang Qiang"), ("东方财富证券", "Q. Wang"), ("东方财富证券", "陈晓东,欧阳娜")] + [("东方财付证券", "王强,晓东陈"), ("Dongfang Caifu Securities", "Chen Xiaodong;娜欧阳")]
    rows += [("华泰证券", "李娜,赵建国"), ("华安证券", "李娜,赵建军"), ("华泰证券", "周小川"), ("华泰证券", "周小川,李小娜"), ("华泰证券", "周川")]
    got = groups_of(names.name_entities(spark.createDataFrame(rows, "ORGAN_NAME string, AUTHOR_NAME string")))
    assert frozenset({"王强", "王 强", "王强（实习）", "Wang Qiang", "Q. Wang"}) in got
    assert frozenset({"陈晓东", "晓东陈", "Chen Xiaodong"}) in got and frozenset({"欧阳娜", "娜欧阳"}) in got
    assert frozenset({"东方财富证券", "东方财付证券", "Dongfang Caifu Securities"}) in got
    assert {frozenset({x}) for x in ("华泰证券", "华安证券", "赵建国", "赵建军", "周小川", "周川")} <= got


def test_given_tables_and_characters_without_a_reading(spark):
    rows = [("荻塘证券", "王建国"), ("荻塘证券", "王健国"), ("荻塘证券", "Wang Jianguo"), ("荻塘证券", "李强"), ("荻塘证券", "Li Qiang"), ("荻塘证券", "赵立新"), ("荻塘证券", "Zhao Lixin"), ("荻塘证券", "孙立新"), ("Ditang Securities", "王建国")]
    df = spark.createDataFrame(rows, "ORGAN_NAME string, AUTHOR_NAME string")
    tables = {"readings": {"王": "wang", "建": "jian", "健": "jian", "国": "guo", "强": "qiang", "李": "li", "塘": "tang", "新": "xin", "赵": "zhao", "孙": "sun", "力": "li", "地": "di"}, "surnames": {"王": "wang", "李": "li", "赵": "zhao", "孙": "sun"}}
    want = {frozenset({"王建国", "王健国", "Wang Jianguo"}), frozenset({"李强", "Li Qiang"}), frozenset({"赵立新", "Zhao Lixin"}), frozenset({"孙立新"}), frozenset({"荻塘证券", "Ditang Securities"})}
    assert groups_of(names.name_entities(df, **tables)) == groups_of(names.name_entities(df)) == want


def test_recall_with_a_tenth_of_the_characters_held_out(spark):
    """Latin spellings, homophones and reversed names of ordinary people, with readings of every tenth of their characters missing."""
    rng = random.Random(12)
    readings, surnames = names.tables(spark)
    given = [c for c in "伟芳秀敏静丽强磊军洋勇艳杰娟涛明超霞平刚桂华红玉兰飞鹏辉斌宇浩凯健俊帆雪琳晨阳萍鑫慧莹颖倩婷瑞嘉欣怡诗博文思涵梓轩" if c in readings]
    families = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何"
    rows, truth = [], {}
    for k in range(240):
        name = rng.choice(families) + "".join(rng.sample(given, 2))
        latin = f"{readings[name[0]].title()} {(readings[name[1]] + readings[name[2]]).title()}"
        broker = f"机构{chr(0x4E00 + k)}证券"
        truth[broker] = (name, latin)
        rows += [(broker, name)] * 3 + [(broker, latin), (broker, f"{latin.split()[1]} {latin.split()[0]}")]
    df = spark.createDataFrame(rows, "ORGAN_NAME string, AUTHOR_NAME string")
    out = set(rng.sample(given, len(given) // 10) + rng.sample(families, 2))
    left = {c: r for c, r in readings.items() if c not in out}
    entity = {r.name: r.entity for r in names.name_entities(df, readings=left).collect() if r.field == "AUTHOR_NAME"}
    hit = [entity[name] == entity[latin] for name, latin in truth.values()]
    assert any(set(name) & out for name, _ in truth.values()) and sum(hit) / len(hit) >= 0.9, sum(hit) / len(hit)


def test_names_of_many_tokens_and_letters_are_found_too(spark):
    word = "".join(chr(97 + k * k % 23) for k in range(400))
    many = " ".join("".join(chr(97 + (k * j) % 19) for j in range(1, 6)) for k in range(1, 30))
    rows = [(word.title() + " Securities", "Some One")] * 3 + [(word[:200].title() + word[201:] + " Securities", "Some One")] + [(many + " Futures", "An Other")] * 2 + [(many[:40] + many[41:] + " Futures", "An Other")]
    got = groups_of(names.name_entities(spark.createDataFrame(rows, "ORGAN_NAME string, AUTHOR_NAME string")))
    assert sum(len(g) == 2 for g in got) == 2


def test_long_chains_of_typos_settle(spark):
    words = ["".join("xyzuvwabcdefghijklmn"[: k + 1]) for k in range(2, 20)]
    rows = [(w.title() + " Securities", "Some One") for k, w in enumerate(words) for _ in range(k + 1)]
    got = groups_of(names.name_entities(spark.createDataFrame(rows, "ORGAN_NAME string, AUTHOR_NAME string")))
    assert frozenset(w.title() + " Securities" for w in words) in got
    turn = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "key string, root string")
    with pytest.raises(RuntimeError):
        names.settled(turn, "turn")
