import random

from pyspark.sql import functions as F

from halyard.llm import stuffing

TOPICS = "渠道 产能 价格 成本 客户 订单 库存 毛利 研发 费用 现金 回款 招标 认证 海外 门店 品牌 物流 原料 政策".split()
FORMS = ["公司在{}推进{}调整，达产后可新增年产值{}亿元，并未影响{}的持续改善。", "我们认为{}水位在四季度仍可维持，主要系{}与{}共同作用，差距约{}%。", "若{}波动延续至全年，{}业务的{}将在{}月前回落。", "管理层表示，对{}的定价较为充分，而{}则受{}拖累，影响{}家客户。"]


def prose(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(FORMS).format(rng.choice(TOPICS) + rng.choice(TOPICS), rng.choice(TOPICS), rng.choice(TOPICS), rng.randrange(9999) / 10) + ("\n" if rng.random() < 0.3 else "") for _ in range(n)) + "\n"


PROSE = prose(0, 4)
ENGLISH = "The board approved the plan for a new plant, to be combined with local sourcing. Demand in the north was weaker than in the first half. "
TABLE = "\n".join(f"毛利率  {k}0.12  {k}8.73  3{k}.5%" for k in range(1, 9)) + "\n"
ROSTER = "出席会议人员：皇甫迦琮、仉岚琮、麴旻苒、宰父舟祺、訾逸槐、濮阳彧澈、巫马菡筠\n"
SPAM = [
    "#股票##涨停##龙头##研报##估值##目标价##分红##行情##主力##股价#" * 4,
    "\n".join(f"首页 某某科技{k} http://news.test/a/{k}" for k in range(20)),
    "\n".join(f"https://www.list.example/a/{k * 991}" for k in range(20)),
    "某某新材股吧哪里查？某某新材股吧看某某新材主力。某某新材主力，某某新材主力怎么样，某某新材主力好不好。" * 5,
    "某甲科技龙头某乙食品股价某丙电子行情某丁医疗估值某戊能源研报某己软件主力某庚光学分红" * 4,
    " ".join(f"59{k:04d} 概念股 00{k:04d} 牛股" for k in range(40)),
    " ".join(f"59{4471 + 13 * k} central Europe 00{4350 + 7 * k} cost of sales" for k in range(20)),
    "荻铄电子股吧、珞钰光学财报、昀衍航服 开户、" * 20,
    "\n".join(f"<词{k}>" for k in range(60)),
]


def pages():
    rows = [(k, prose(k, 3 + k % 9) + ("" if k % 3 else ENGLISH)) for k in range(60)]
    rows += [(100 + k, s) for k, s in enumerate(SPAM)]
    rows += [(200, PROSE + TABLE * 3), (201, PROSE + ROSTER), (202, prose(5, 6) + "#标签 #话题"), (203, ""), (204, None), (205, prose(77, 20_000)), (206, PROSE + SPAM[0] * 2)]
    return rows


def test_spam_is_found_and_documents_with_structure_are_not(spark):
    df = spark.createDataFrame(pages(), "doc_id long, text string").withColumn("prose", F.lit("x"))
    got = {r.doc_id for r in stuffing.flagged(stuffing.line_shares(df)).collect()}
    assert got == set(range(100, 100 + len(SPAM))) | {206}


def test_shares_and_empty_input(spark):
    df = spark.createDataFrame(pages(), "doc_id long, text string")
    rows = stuffing.line_shares(df).collect()
    assert len(rows) == len(pages())
    for r in rows:
        total = sum(r[s] for s in stuffing.STATES)
        assert abs(total - (1 if r.n_chars else 0)) < 1e-9
    assert stuffing.line_shares(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert [r.n_lines for r in stuffing.line_shares(blank).collect()] == [0, 0]


def test_decoding_equals_brute_force():
    import itertools

    import numpy as np

    texts = [PROSE, SPAM[1][:120], PROSE + SPAM[0]]
    docs, _, symbols = stuffing.line_shapes(texts)
    model = stuffing.train([t for _, t in pages() if t][:70])
    got = model.decode(docs, symbols)
    for d in range(len(texts)):
        rows = symbols[docs == d][:5]
        score = sum(t[:, rows[:, k]].T for k, t in enumerate(model.symbols))
        best = max(itertools.product(range(6), repeat=len(rows)), key=lambda p: model.first[p[0]] + score[0, p[0]] + sum(model.moves[a, b] + score[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:]))))
        assert np.array_equal(model.decode(np.zeros(len(rows), int), rows), best)
    assert len(got) == len(docs)


def test_shapes_do_not_depend_on_slices(spark):
    import numpy as np

    url = "http://news.test/" + "a/b" * 300
    texts = [prose(3, 40) + "x" * 700 + "。" + ENGLISH * 3 + "\n" + url + " 1234567 " + "9" * 400 + ".", PROSE, SPAM[3] * 3, "a", TABLE * 4 + "https://x.test/q\n" + SPAM[5], " " * 500]
    want = stuffing.line_shapes(texts, 10**6)
    for chunk in (1, 7, 129, 1000):
        assert all(np.array_equal(x, y) for x, y in zip(want, stuffing.line_shapes(texts, chunk))), chunk
    for k, t in enumerate(texts):  # nor on the texts beside it
        docs, size, symbols = stuffing.line_shapes([t])
        assert np.array_equal(size, want[1][want[0] == k]) and np.array_equal(symbols, want[2][want[0] == k]) and size.sum() == len(t) + 1
    df = spark.createDataFrame([(k, prose(k, 60) + SPAM[k % 3] * 3) for k in range(12)], "doc_id long, text string")
    key = lambda r: r.doc_id
    assert sorted(stuffing.line_shares(df).collect(), key=key) == sorted(stuffing.line_shares(df, chunk=900).collect(), key=key)


def test_model_keeps_to_the_seeds_whatever_was_drawn():
    import numpy as np

    texts = [t for _, t in pages() if t]
    docs, size, symbols = stuffing.line_shapes(texts)
    plain = [t for t in texts if t not in SPAM][:40]
    for drawn in (texts, plain + SPAM[:9], texts[30:]):
        labels = stuffing.train(drawn).decode(docs, symbols)
        bad = np.bincount(docs, size * np.isin(labels, [2, 3, 4, 5])) / np.bincount(docs, size)
        assert {texts[k] for k in np.flatnonzero(bad > 0.5)} == {*SPAM, PROSE + SPAM[0] * 2}
