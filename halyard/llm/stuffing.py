"""Keyword-stuffed pages and link lists: a hidden Markov model over the lines of a page.

A line is what stands between line ends and sentence ends. Its shape (addresses, repetition close by, function words, separators,
figures, unbroken runs, sentence end) is coded in a few symbols; the model's states are prose, table (rows of figures, contents, lists of
attendees: structure of a document, no spam), link list, tag list, menu, and stuffed phrases. Emissions and transitions start from
seed rules and are re-estimated on a bounded sample; then the most likely labels of all lines of every page are decoded,
and a page is flagged by the share of its characters on lines of the last four states.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators.sampling import hash_sample

STATES = ["prose", "table", "link", "tag", "menu", "stuffed"]
PROSE, TABLE, LINK, TAG, MENU, STUFFED = range(6)
SAMPLE, ROUNDS, REACH, HOLD, ANCHOR = 3_000, 3, 120, 1.0, 0.1

# fixed values: common function words and grammatical characters
_HAN_FUNCTION = "的了在与为并使由将而则其及和是有从对被后前时已可仍以约较因不我们至令但若本未也都很这那之"
_ENGLISH_FUNCTION = re.compile(r"\b(?:the|a|an|of|and|in|to|for|with|by|on|at|is|was|were|are|be|from|as|after|that|than|could|should|most|up|down|our|we|not|per|although|before|over|its)\b", re.I)
_ADDRESS = re.compile(r"(?:<a\s+href=\"?|\]\()?(?:https?://|www\.)[^\s　<>\"')\]，。、]+(?:\">|\))?")

_HAN, _LATIN, _DIGIT, _SPACE, _LINE, _END, _COMMA, _MARK, _OTHER = range(9)


def _class_table() -> np.ndarray:
    t = np.full(0x110000, _OTHER, np.uint8)
    t[0x3400:0xA000] = _HAN
    t[0x20000:0x33480] = _HAN
    for a, b in (("a", "z"), ("A", "Z")):
        t[ord(a) : ord(b) + 1] = _LATIN
    t[0xC0:0x250] = _LATIN
    t[ord("0") : ord("9") + 1] = _DIGIT
    for chars, k in ((" \t　 ", _SPACE), ("\n\r", _LINE), ("。！？!?；;", _END), ("，,：:", _COMMA), ("|#·»_<>【】[]/~*•、>-=", _MARK)):
        for c in chars:
            t[ord(c)] = k
    return t


_CLASS = _class_table()
_FUNCTION = np.zeros(0x110000, bool)
_FUNCTION[[ord(c) for c in _HAN_FUNCTION]] = True


#: What a slice sees on either side: as far as repetition reaches, and the runs of characters that are told apart by length.
_SIDE = REACH + 8


class _Slice:
    """Part of a text with its surroundings: ``left`` characters before its own ones, ``own`` of these, and some behind."""

    def __init__(self, doc: int, low: int, begin: int, own: int, part: str):
        self.doc, self.low, self.left, self.own, self.part = doc, low, begin - low, own, part


def _slices(doc: int, text: str, most: int) -> Iterator[_Slice]:
    """The slices of a text and the line end behind it; each character is the own one of exactly one slice."""
    for begin in range(0, len(text) + 1, most):
        own = min(most, len(text) + 1 - begin)
        low, high = max(0, begin - _SIDE), begin + own + _SIDE
        yield _Slice(doc, low, begin, own, text[low:high] + ("\n" if high > len(text) else ""))


def _marked(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of addresses, and begins of English function words, of a whole text."""
    address = [m.span() for m in _ADDRESS.finditer(text)] if "://" in text or "www." in text else []
    words = [m.start() for m in _ENGLISH_FUNCTION.finditer(text)] if re.search(r"[A-Za-z]{2} [A-Za-z]{2}", text) else []
    spans = np.array(address, np.int64).reshape(-1, 2)
    return spans[:, 0], spans[:, 1], np.array(words, np.int64)


_SUMS = ["size", "han", "latin", "digit", "space", "comma", "mark", "address", "again", "words", "function", "decimal", "leader", "starts", "capital", "codes", "listed", "wide_colon", "colon"]


def _measured(slices: list[_Slice], marks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, sums, longest runs and (ends a line, by a sentence mark, by a line end) of every line, or piece of a line, of some slices."""
    n = [len(s.part) for s in slices]
    cp = np.frombuffer("".join(s.part for s in slices).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    start = np.repeat(begin, n)
    own, address, words = (np.zeros(len(cp), bool) for _ in range(3))
    for s, o in zip(slices, begin):
        own[o + s.left : o + s.left + s.own] = True
        a, b, w = marks[s.doc]
        for k in range(np.searchsorted(b, s.low, side="right"), np.searchsorted(a, s.low + len(s.part))):
            address[o + max(0, a[k] - s.low) : o + min(len(s.part), b[k] - s.low)] = True
        words[o + w[np.searchsorted(w, s.low) : np.searchsorted(w, s.low + len(s.part))] - s.low] = True
    at = np.arange(len(cp))
    kind = _CLASS[cp]
    nxt = np.append(kind[1:], _LINE)
    prv = np.append(_LINE, kind[:-1]).astype(np.uint8)
    prv[begin] = _LINE
    dot = (cp == ord(".")) & ((nxt == _SPACE) | (nxt == _LINE)) & (prv != _OTHER)
    ends = (kind == _LINE) | (kind == _END) | dot

    # a character repeats if the four from here on stand again within REACH before or behind in the same text
    c = np.append(cp, np.zeros(3, np.uint32)).astype(np.uint64)
    h = start.astype(np.uint64) + np.uint64(1)
    for k in range(4):
        h = (h ^ c[k : k + len(cp)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    full_four = at + 4 <= np.repeat(begin + n, n)
    at_four = at[full_four]
    order = at_four[np.argsort(h[full_four], kind="stable")]
    close = (h[order[1:]] == h[order[:-1]]) & (order[1:] - order[:-1] <= REACH)
    again = np.zeros(len(cp), bool)
    again[order[1:][close]] = True
    again[order[:-1][close]] = True

    solid = (kind == _HAN) | (kind == _LATIN) | (kind == _DIGIT)
    length = lambda x: at - np.maximum(np.maximum.accumulate(np.where(x, -1, at)), start - 1)
    run = length(solid)
    flags = {
        "size": np.ones(len(cp), bool), "han": kind == _HAN, "latin": kind == _LATIN, "digit": kind == _DIGIT, "space": kind == _SPACE, "comma": kind == _COMMA, "mark": kind == _MARK, "address": address, "again": again, "words": words,
        "function": _FUNCTION[cp], "decimal": (cp == ord(".")) & (prv == _DIGIT) & (nxt == _DIGIT), "leader": ((cp == ord(".")) & (np.append(cp[1:], 0) == ord("."))) | (cp == ord("…")), "starts": (kind == _LATIN) & (prv != _LATIN),
        "capital": (kind == _LATIN) & (cp < 97) & (prv == _LATIN), "codes": length(kind == _DIGIT) == 6, "listed": cp == ord("、"), "wide_colon": cp == ord("："), "colon": cp == ord(":"),
    }
    # own characters only, cut behind every line end and where a slice begins
    ends, kind, dot, run = ends[own], kind[own], dot[own], run[own]
    opens = np.concatenate([[0], np.cumsum([s.own for s in slices])[:-1]]).astype(np.int64)
    first = np.unique(np.concatenate([opens, np.flatnonzero(ends)[:-1] + 1 if ends[-1] else np.flatnonzero(ends) + 1]))
    sums = np.stack([np.add.reduceat(flags[f][own].astype(np.int64), first) for f in _SUMS], axis=1)
    runs = np.stack([np.maximum.reduceat(run, first), np.maximum.reduceat(np.where(kind == _LATIN, run, 0), first)], axis=1)
    last = np.append(first[1:], len(ends)) - 1
    closing = np.stack([ends[last], (kind[last] == _END) | dot[last], kind[last] == _LINE], axis=1)
    docs = np.repeat([s.doc for s in slices], [s.own for s in slices])[first]
    return docs, sums, runs, closing


def line_shapes(texts: list[str], chunk: int = 250_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, length in characters and symbols (lines x features) of all lines of non-empty texts.

    Texts are measured by slices of at most ``chunk`` characters, each with its surroundings, and the pieces of a line cut by a slice are put
    together, so that the result does not depend on ``chunk``.
    """
    found, held, size = [], [], 0
    marks = {}
    for doc, text in enumerate(texts):
        marks[doc] = _marked(text)
        for s in _slices(doc, text, chunk):
            if held and size + s.own > chunk:
                found.append(_measured(held, marks))
                marks = {doc: marks[doc]}
                held, size = [], 0
            held.append(s)
            size += s.own
    found.append(_measured(held, marks))
    docs, sums, runs, closing = (np.concatenate(x) for x in zip(*found))
    first = np.flatnonzero(np.append(True, closing[:-1, 0]))  # a piece goes on where the one before did not end a line
    m = dict(zip(_SUMS, np.add.reduceat(sums, first).T))
    runs = np.maximum.reduceat(runs, first)
    _, stop, line = closing[np.append(first[1:], len(docs)) - 1].T
    size = m["size"]
    latin = m["latin"] > m["han"]
    function = np.where(latin, m["words"] * 5, m["function"]) / size
    gaps = m["mark"] + np.where(latin, 0, m["space"])
    parts = gaps + m["comma"] + 1
    share = lambda x: x / size
    symbols = np.stack(
        [
            np.digitize(share(m["address"]), [0.01, 0.3]),
            np.digitize(share(m["again"]), [0.1, 0.3, 0.55]),
            np.digitize(function, [0.001, 0.03, 0.08]),
            np.digitize(share(gaps), [0.001, 0.03, 0.08]),
            np.digitize(share(m["digit"]), [0.001, 0.12, 0.35]),
            np.digitize(share(m["decimal"]), [0.001, 0.04]) + 3 * (share(m["leader"]) > 0.12),
            np.where(latin, np.digitize(runs[:, 1], [15, 22]), np.digitize(runs[:, 0], [26, 42])),
            np.where(stop, 1, 0) + 2 * (m["comma"] > 0),
            np.digitize(size / parts, [4.6, 8, 14]),
            np.digitize(size, [6, 26, 80]),
            (latin & (m["starts"] > 0) & (function == 0)).astype(int) + 2 * (share(m["capital"]) > 0.3),
            np.digitize(share(m["codes"]), [0.001, 0.02]),
            ((m["wide_colon"] > 0) & (size < 60) & line & (m["digit"] == 0) & (m["listed"] < 3)).astype(int),
            np.digitize(m["listed"], [3]) * ((m["wide_colon"] + m["colon"] > 0) + 1),
        ],
        axis=1,
    )
    return docs[first], size, symbols.astype(np.int8)


#: Number of symbols of each feature.
WIDTHS = [3, 4, 4, 4, 4, 6, 3, 4, 4, 4, 4, 3, 2, 3]
_ADDR, _AGAIN, _FUNC, _GAP, _DIG, _DEC, _RUN, _STOP, _PART, _SIZE, _LAT, _CODE, _HEAD, _LIST = range(14)


def seed_labels(x: np.ndarray) -> np.ndarray:
    """Rule labels of lines, from which the model starts; later rules win."""
    out = np.full(len(x), PROSE)
    plain = (x[:, _FUNC] <= 1) & (x[:, _DEC] == 0)
    out[(x[:, _SIZE] <= 1) & (x[:, _STOP] == 0) & (x[:, _FUNC] == 0)] = MENU
    out[plain & (x[:, _GAP] >= 2) & (x[:, _STOP] != 3) & (x[:, _SIZE] >= 1)] = TAG
    out[plain & (x[:, _RUN] == 2) & (x[:, _FUNC] <= 1)] = TAG
    out[plain & (x[:, _DIG] == 3) & (x[:, _SIZE] >= 1)] = TAG
    out[(x[:, _CODE] == 2) & (x[:, _DEC] == 0) & (x[:, _STOP] != 3) & (x[:, _SIZE] >= 1)] = TAG
    out[(x[:, _LAT] == 1) & plain & (x[:, _SIZE] >= 1) & (x[:, _STOP] == 0)] = TAG
    out[x[:, _HEAD] == 1] = PROSE  # a headline
    sentence = (x[:, _FUNC] == 3) & (x[:, _STOP] % 2 == 1)  # many function words, and ends as one: repeated wording, but wording
    out[(x[:, _AGAIN] == 3) & (x[:, _SIZE] >= 1) & ~sentence] = STUFFED
    out[(x[:, _DEC] >= 3) | ((x[:, _DEC] == 2) & (x[:, _FUNC] == 0)) | ((x[:, _LIST] == 2) & (x[:, _PART] == 0) & (x[:, _AGAIN] <= 1))] = TABLE
    out[x[:, _ADDR] == 2] = LINK
    return out


def _counts(docs: np.ndarray, symbols: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Counts of first states, of transitions, and of each feature's symbols by state."""
    n = len(STATES)
    start = np.append(True, docs[1:] != docs[:-1])
    moves = np.zeros((n, n))
    np.add.at(moves, (labels[:-1][~start[1:]], labels[1:][~start[1:]]), 1)
    out = [np.bincount(labels[start], minlength=n).astype(float), moves]
    for k, width in enumerate(WIDTHS):
        seen = np.zeros((n, width))
        np.add.at(seen, (labels, symbols[:, k]), 1)
        out.append(seen)
    return out


#: Labelled example pages, all lines of one state: they stand for states that the drawn texts may lack.
EXAMPLES = {
    PROSE: [
        "公司昨日召开了年度股东大会，会上管理层介绍了新产线的建设进度，并且回答了投资者的提问。我们认为需求仍将保持平稳。由于原料价格回落，毛利率有所改善，但是费用仍然偏高。",
        "投资者问：请问贵公司今年的分红计划是怎样的？\n董秘答：您好，公司将在年度报告中披露利润分配方案，敬请关注，谢谢。\n以上内容仅供参考，不构成投资建议。",
        "The company said on Tuesday that it would open a second plant in the south, although demand was weaker than in the year before. Margins should recover as costs are passed on to customers.",
        "We keep our rating and lower the target price. Our estimates are below those of the market, because the order book has not grown since the spring.",
    ],
    TABLE: [
        "营业收入  102.35  118.62  131.07\n净利润  12.41  14.03  15.88\n每股收益  0.52  0.61  0.70\n毛利率  31.2%  32.0%  32.5%",
        "第一章 概况 ........ 1\n第二章 行业分析 ........ 5\n第三章 财务预测 ........ 12\n第四章 风险提示 ........ 20",
        "参会人员：王建国、李秀英、张志强、刘桂兰、陈永明\n参会机构：甲基金、乙证券、丙保险、丁资本",
        "Revenue  1023.5  1186.2  1310.7\nNet profit  124.1  140.3  158.8\nMargin  12.1%  11.8%  12.1%",
    ],
    LINK: [
        "https://www.example.com/news/10231\nhttps://www.example.com/news/10232\nhttps://www.example.com/news/10233\nhttps://www.example.com/news/10234",
        "上一篇 http://example.org/a/1.html\n下一篇 http://example.org/a/2.html\n更多 http://example.org/list.html",
        '<a href="http://example.net/p/1">one</a> <a href="http://example.net/p/2">two</a>\n<a href="http://example.net/p/3">three</a>',
    ],
    TAG: [
        "#股票# #基金# #理财# #开户# #行情# #涨停# #龙头股#",
        "手机 | 电脑 | 相机 | 耳机 | 手表 | 平板 | 音箱 | 键盘 | 鼠标",
        "股票开户 低佣金 炒股软件 下载 免费 行情 软件 排行 推荐 哪个好",
        "cheap phones, phone deals, best phone, phone case, phone cover, phone shop, buy phone",
    ],
    MENU: ["首页\n新闻\n财经\n体育\n娱乐\n科技\n登录\n注册\n关于我们", "Home\nNews\nMarkets\nLogin\nSign up\nContact\nAbout", "返回顶部\n网站地图\n联系我们\n版权声明"],
    STUFFED: [
        "炒股开户哪家好，炒股开户怎么开，炒股开户手续费，炒股开户流程，炒股开户哪家好，炒股开户怎么开，炒股开户要多少钱。炒股开户找炒股开户网，炒股开户就上炒股开户网。",
        "best loans online best loans cheap best loans fast best loans online best loans today best loans online cheap",
    ],
}


class LineModel:
    """Log-probabilities of first states, transitions and symbols."""

    def __init__(self, counts: list[np.ndarray]):
        first, moves, *symbols = counts
        self.first = np.log((first + 1) / (first + 1).sum())
        self.moves = np.log((moves + 2) / (moves + 2).sum(axis=1, keepdims=True))
        self.symbols = [np.log((seen + 1) / (seen + 1).sum(axis=1, keepdims=True)) for seen in symbols]

    def decode(self, docs: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Most likely states, all documents side by side: one step per line number."""
        score = sum(t[:, symbols[:, k]].T for k, t in enumerate(self.symbols))
        begin = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        length = np.diff(np.append(begin, len(docs)))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        back = np.zeros(score.shape, np.int8)
        best = self.first + score[begin]
        final = best.copy()
        for t in range(1, length[0]):
            live = np.searchsorted(-length, -t, side="left")  # documents with more than t lines
            path = best[:live, :, None] + self.moves
            at = begin[:live] + t
            back[at] = path.argmax(axis=1)
            best = path.max(axis=1) + score[at]
            final[:live] = best
        out = np.zeros(len(docs), np.int8)
        state = final.argmax(axis=1)
        for t in range(length[0] - 1, -1, -1):
            live = np.searchsorted(-length, -t, side="left") if t else len(begin)
            at = begin[:live] + t
            out[at] = state[:live]
            state[:live] = back[at, state[:live]]
        return out


def train(texts: list[str], rounds: int = ROUNDS, lines: int = 200, hold: float = HOLD, anchor: float = ANCHOR) -> LineModel:
    """Seed labels, then ``rounds`` of decoding and re-estimation, in which the seeds count ``hold`` times as much as decoded lines, and the lines of the
    labelled examples together ``anchor`` times as much as all drawn lines, so that the states keep their meaning whatever texts were drawn. Of one text at most ``lines`` lines take part, so that no
    single long text makes the model."""
    docs, _, symbols = line_shapes(texts)
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    used = np.arange(len(docs)) - np.repeat(first, np.diff(np.append(first, len(docs)))) < lines
    docs, symbols = docs[used], symbols[used]
    seeds = _counts(docs, symbols, seed_labels(symbols))
    shown = _counts(*_example_lines())
    anchor *= len(docs) / shown[2].sum()
    model = LineModel([s + anchor * e for s, e in zip(seeds, shown)])
    for _ in range(rounds):
        found = _counts(docs, symbols, model.decode(docs, symbols))
        model = LineModel([d + hold * s + anchor * e for d, s, e in zip(found, seeds, shown)])
    return model


def _example_lines() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, symbols and state of every line of the labelled examples."""
    pages = [(state, page) for state, found in EXAMPLES.items() for page in found]
    docs, _, symbols = line_shapes([page for _, page in pages])
    return docs, symbols, np.array([state for state, _ in pages])[docs]


def line_shares(documents: DataFrame, ident: str = "doc_id", text: str = "text", sample: int = SAMPLE, chunk: int = 250_000, seed: int = 5) -> DataFrame:
    """Per document the number of lines, of characters, and the share of characters on lines of each state.

    The model is trained on the non-empty ones of at most ``sample`` texts, those with the smallest hash of their id; all texts are decoded whole.
    Long texts are measured by slices of ``chunk`` characters, which bounds memory and changes no label.
    Null and empty texts have no lines and all shares 0. Repeated ids give repeated rows. An empty table gives an empty result.
    """
    source = documents.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    drawn = [r["text"] for r in hash_sample(source, ["doc_id"], sample, seed) if r["text"]]
    model = train(drawn) if drawn else None

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            cells = np.zeros((len(texts), len(STATES)), np.int64)
            lines = np.zeros(len(texts), np.int32)
            rows, held = [], 0
            for i, t in enumerate([*texts, None]):
                if rows and (t is None or held + len(t) > chunk):
                    docs, size, symbols = line_shapes([texts[k] for k in rows], chunk)
                    np.add.at(cells, (np.array(rows)[docs], model.decode(docs, symbols)), size)
                    np.add.at(lines, np.array(rows)[docs], 1)
                    rows, held = [], 0
                if t:
                    rows.append(i)
                    held += len(t)
            share = cells / np.maximum(1, cells.sum(axis=1, keepdims=True))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_lines": lines, "n_chars": [len(t) for t in texts], **{s: share[:, k] for k, s in enumerate(STATES)}})

    return source.mapInPandas(decode, f"doc_id {kind}, n_lines int, n_chars int, " + ", ".join(f"{s} double" for s in STATES))


def flagged(shares: DataFrame, most: float = 0.5) -> DataFrame:
    """Documents with more than ``most`` of their characters on link, tag, menu and stuffed lines."""
    return shares.where(F.col("link") + F.col("tag") + F.col("menu") + F.col("stuffed") > most)
