import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import pieces

BITS = ["短句。", "一个长一些的句子，带着逗号，还有数字12.5%。", "English sentence here. ", "\n", "\r\n\r\n", "  ", "没有标点的一段文字" * 6, "？！”", "a b c d ", "；", "\U0001f600"]


def text_of(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def joined(parts):
    out = ""
    for p in sorted(parts, key=lambda p: p.piece_no):
        assert p.start <= len(out)
        out = out[: p.start] + p.piece
        assert len(out) == p.end
    return out


def test_round_trip_limits_and_overlap(spark):
    rng = random.Random(4)
    texts = {f"t{k}": text_of(rng, rng.randrange(1, 400)) for k in range(60)} | {"none": "", "wall": "字" * 5000, "edge": "x" * 1200, "over": "x" * 1201}
    df = spark.createDataFrame([*texts.items(), ("null", None)], "id string, piece string").selectExpr("id", "piece", "1 AS start")
    got = {}
    for r in pieces.split_texts(df, "id", "piece").collect():
        got.setdefault(r.ident, []).append(r)
    assert set(got) == set(texts)
    for k, text in texts.items():
        parts = sorted(got[k], key=lambda p: p.piece_no)
        assert joined(parts) == text
        assert [p.piece_no for p in parts] == list(range(len(parts)))
        assert all(p.end - p.start <= 1200 for p in parts)
        assert (len(parts) > 1) == (len(text) > 1200)
        assert all(50 <= a.end - b.start <= 150 for a, b in zip(parts, parts[1:]))
    assert len(got["edge"]) == 1 and len(got["over"]) == 2
    assert pieces.split_texts(df.limit(0), "id", "piece").count() == 0


def test_cuts_lie_at_ends_where_there_are_any():
    text = ("这是一个普通的句子，长度适中，用来检查切分。" * 200)[:4000]
    at, kind = pieces.boundaries(text)
    ends = set(at[kind >= pieces.SENTENCE].tolist())
    cuts = pieces.cut(len(text), at, kind)
    assert all(b in ends for _, b in cuts[:-1]) and all(a in ends for a, _ in cuts[1:])


RUNS = st.lists(st.sampled_from(["字", "a", ".", "。", "”", "）", " ", "\n", "\r\n", "，", ",", "7", "\U0001f600", " " * 300, "\n" * 90, "”" * 70, "\u3000"]), max_size=60).map("".join)


def plain_boundaries(text):
    """The definition, character by character."""
    out, k = [], 0

    def kind(i):
        c, after = text[i], text[i + 1 : i + 2]
        if c == ".":
            return pieces.SENTENCE if after and (after.isspace() or after in "”’」』）)\"'") else 0
        if c in ",:":
            return 0 if after and after in "0123456789" else pieces.CLAUSE
        return pieces.PARAGRAPH if c in "\r\n" else pieces.WORD if c.isspace() else pieces.SENTENCE if c in "。！？!?…；;" else pieces.CLAUSE if c in "，、：" else 0

    while k < len(text):
        if not kind(k):
            k += 1
            continue
        best = 0
        while k < len(text) and (kind(k) or text[k] in "”’」』）)\"'"):
            best = max(best, kind(k))
            k += 1
        if k < len(text):
            out.append((k, best))
    return out


@settings(max_examples=300, deadline=None)
@given(RUNS, st.sampled_from([1, 2, 3, 7, 64, 4096]))
def test_boundaries_do_not_depend_on_ranges(text, span):
    at, kind = pieces.boundaries(text, span)
    assert list(zip(at.tolist(), kind.tolist())) == plain_boundaries(text)


@pytest.mark.parametrize("span,segment", [(1_000, 1 << 20), (4_096, 4_000), (100_000, 7_001)])
def test_files_by_range_give_the_same_pieces_as_texts(spark, tmp_path, span, segment):
    rng = random.Random(span)
    texts = {"a": text_of(rng, 9_000), "b": "", "c": "字" * 5_000, "d": "短。", "e": "句子。" + " " * 9_000 + "完" * 2_000 + "”" * 3_000 + "\n" * 3_000 + text_of(rng, 500), "f": "x" * 1_200}
    for k, text in texts.items():
        (tmp_path / k).write_bytes(text.encode())
    paths = {f"file://{tmp_path / k}": k for k in texts}
    got = sorted((paths[r.path], r.piece_no, r.start, r.end, r.piece) for r in pieces.split_files(spark, [*paths, *paths], span=span, segment=segment).collect())
    df = spark.createDataFrame([*texts.items()], "id string, text string")
    want = sorted(tuple(r) for r in pieces.split_texts(df, "id", "text", segment=segment).collect())
    assert got == want
    for k, text in texts.items():
        parts = [pieces.pd.Series(dict(zip(("piece_no", "start", "end", "piece"), g[1:]))) for g in got if g[0] == k]
        assert joined(parts) == text and all(p.end - p.start <= 1200 for p in parts)


def test_null_and_repeated_idents_keep_each_row(spark):
    rng = random.Random(9)
    a, b, c = (text_of(rng, n) for n in (700, 900, 800))
    rows = [("r", a), ("r", b), ("r", b), (None, c), (None, a), ("s", "短。")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = pieces.split_texts(df, "id", "text").collect()
    alone = {t: pieces.split_texts(spark.createDataFrame([("x", t)], "id string, text string"), "id", "text").collect() for t in (a, b, c)}
    bare = lambda rows: sorted((r.piece_no, r.start, r.end, r.piece) for r in rows)
    assert bare(r for r in got if r.ident == "r") == bare([*alone[a], *alone[b], *alone[b]])
    assert bare(r for r in got if r.ident is None) == bare([*alone[c], *alone[a]])


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        pieces.split_texts(spark.createDataFrame([("a", "b")], "id string, text string"), "id", "text", limit=100, overlap=60)
