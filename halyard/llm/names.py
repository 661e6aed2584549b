"""Variant spellings of names typed by people: brokers and analysts.

Distinct spellings are few beside the rows, so everything here runs on spellings and the contexts they occur in.
A spelling is broken into tokens (Han characters by their reading, from a dictionary of all characters; Latin words in lower case;
decorations, legal forms and departments dropped). Complete spellings with the same tokens share a key. A symmetric-delete index over tokens
(each token with one letter left out, on both sides) proposes pairs of keys at a small edit distance, and probes for initials, given names,
nicknames and bare stems propose keys for incomplete spellings; an optimal assignment of tokens prices each
proposal, and one that is not exact counts only if both sides share a context (analysts of the broker, brokers of the analyst).
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.session import materialize

# fixed values: the commonest surnames of one character, some rare ones, and surnames of two characters
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
    "乜仉佴厍眭禚笪缑訾逄郏郗隗麴"
)
COMPOUND_SURNAMES = (
    "欧阳 上官 司马 诸葛 东方 尉迟 公孙 慕容 令狐 宇文 长孙 司徒 夏侯 淳于 太史 申屠 皇甫 端木 澹台 濮阳 公冶 钟离 鲜于 轩辕 赫连 独孤 南宫 西门 东郭 百里 呼延 闻人 万俟 单于 公羊 太叔 宗政 仲孙 司空 司寇 亓官 壤驷 夹谷 宰父 巫马 漆雕 谷梁 闾丘"
).split()
# fixed values: readings in names that differ from a character's first reading
NAME_READINGS = {"澹台": "tantai", "尉迟": "yuchi", "万俟": "moqi", "单": "shan", "解": "xie", "查": "zha", "仇": "qiu", "区": "ou", "曾": "zeng", "覃": "qin", "乜": "nie", "郗": "chi", "隗": "kui", "峤": "qiao", "陂": "bei", "重": "chong", "行": "xing"}
# fixed values: characters often mistaken for one another by their looks, groups of two or three
LOOKALIKES = "荻获 泠冷 己已巳 戊戌戍 未末 土士 日曰 晴睛 大太 天夭 王玉 千干于 人入 免兔 侯候 崇祟 宜宣 岚风 拔拨 折拆 汨汩 洛落 治冶 沛柿 淡谈 热熟 券卷 祺棋 衷哀 辨辩 遣遗 钧钓 锋峰 陈阵 雪云 弘宏 栗粟 萧箫".split()

# fixed values: lines of business, written out and abbreviated, Han and Latin
LINES = {"证券": "securities", "证": "securities", "期货": "futures", "期": "futures", "资本": "capital", "国际": "international", "资管": "assets", "基金": "funds"}
LATIN_LINES = {"securities": "securities", "sec": "securities", "futures": "futures", "fut": "futures", "capital": "capital", "cap": "capital", "international": "international", "int": "international", "intl": "international", "partners": "partners", "par": "partners", "part": "partners"}
_TRADITIONAL = str.maketrans("證劵國際資貨馬陽鍾離閭鮮於", "证券国际资货马阳钟离闾鲜于")
_DEPARTMENTS = re.compile(r"[（(](?:研究部|研究所|研究院|研发中心|沪|深|京|香港|上海|北京|深圳)[）)]|(?:证券研究部|研究所|研究院|研发中心|研究部)$|^研究所-|股份有限公司|有限责任公司|有限公司")
_LEGAL = {"the", "co", "ltd", "inc", "llc", "limited", "corp"}
_TITLES = re.compile(r"^分析师|^首席|(?:老师|博士|先生|女士)$|[（(][^（()）]*[)）]|_[A-Za-z]+$|\s+(?:CFA|CPA|FRM|PhD|MBA)$", re.I)


#: The tables in use in a process: reading of a character, reading of a surname, characters that look like a character.
_TABLES: dict[str, dict] = {"readings": {}, "surnames": {}, "looks": {c: [o for o in group if o != c] for group in LOOKALIKES for c in group}}


def use_tables(readings: dict[str, str], surnames: dict[str, str]) -> None:
    """Take these tables from now on in this process."""
    if readings != _TABLES["readings"] or surnames != _TABLES["surnames"]:
        _TABLES.update(readings=readings, surnames=surnames, known=set(readings.values()), families=set(surnames.values()))
        syllables.cache_clear()


_DICTIONARY: dict[str, str] = {}


def dictionary(spark: SparkSession) -> dict[str, str]:
    """Reading of every Han character, without tones, from the transliterator of the ICU library on Spark's class path."""
    if not _DICTIONARY:
        latin = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII")
        chars = [chr(c) for c in (*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000))]
        found = latin.transliterate("|".join(chars)).split("|")
        _DICTIONARY.update({c: r for c, r in zip(chars, found) if re.fullmatch("[a-z]+", r)} | {c: r for c, r in NAME_READINGS.items() if len(c) == 1})
    return _DICTIONARY


def tables(spark: SparkSession, readings: dict[str, str] | None = None, surnames: dict[str, str] | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """(readings, surnames) to work with: the dictionary and the listed surnames where none are given."""
    readings = dictionary(spark) if readings is None else readings
    if surnames is None:
        surnames = {f: NAME_READINGS.get(f, "".join(readings.get(c, c) for c in f)) for f in (*SURNAMES, *COMPOUND_SURNAMES)}
    return readings, surnames


def _readings() -> dict[str, str]:
    return _TABLES["readings"]


def _surnames() -> dict[str, str]:
    return _TABLES["surnames"]


def _read(chars: str) -> list[str]:
    return [_readings().get(c, c) for c in chars]


def _han(text: str) -> bool:
    return any("㐀" <= c <= "鿿" or c >= "\U00020000" for c in text)


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with one letter left out, put in or replaced, or two neighbours swapped (or the same)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    short, long = (a, b) if len(a) < len(b) else (b, a)
    return short[i:] == long[i + 1 :]


def token_price(a: str, b: str) -> float:
    """0 for the same token, 0.3 for an initial or abbreviation, 1 for one edit or for a character without a reading against a
    syllable, else 3."""
    if a == b:
        return 0.0
    if a and b and (a.startswith(b) or b.startswith(a)) and min(len(a), len(b)) == 1:
        return 0.3
    if (len(a) == 1 and _han(a)) != (len(b) == 1 and _han(b)):
        return 1.0
    return 1.0 if min(len(a), len(b)) > 2 and one_edit(a, b) else 3.0


def assignment_price(a: list[str], b: list[str], missing: float = 0.5) -> float:
    """Least total price of matching the tokens of a to those of b, in any order; a token without partner costs ``missing``.

    Shortest augmenting paths with potentials, of cubic time in the number of tokens; rows are filled up with missing tokens.
    """
    if len(a) > len(b):
        a, b = b, a
    n = len(b)
    cost = [[token_price(x, y) for y in b] for x in a] + [[missing] * n] * (n - len(a))
    u, v, row, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row[0], j = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j], at, delta, to = True, row[j], float("inf"), 0
            for k in range(1, n + 1):
                if not used[k]:
                    c = cost[at - 1][k - 1] - u[at] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(n + 1):
                if used[k]:
                    u[row[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = to
            if not row[j]:
                break
        while j:
            row[j], j = row[way[j]], way[j]
    return sum(cost[row[k] - 1][k - 1] for k in range(1, n + 1))


_PRIME, _BASE = (1 << 61) - 1, 911_382_323


def deletions(items: list[int]) -> list[int]:
    """Hashes of a sequence with each item left out in turn; linear in its length."""
    n = len(items)
    before, power = [0], [1]
    for x in items:
        before.append((before[-1] * _BASE + x + 1) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    return [(before[i] * power[n - i - 1] + before[n] - before[i + 1] * power[n - i - 1]) % _PRIME for i in range(n)]


def _whole(items: list[int]) -> int:
    h = 0
    for x in items:
        h = (h * _BASE + x + 1) % _PRIME
    return h


def left_out(token: str) -> set[int]:
    """The symmetric-delete neighbourhood: hashes of the token and of every form with one letter left out, for tokens of any length.
    Equal hashes only propose; prices compare the tokens themselves."""
    items = [ord(c) for c in token]
    return {_whole(items)} | (set(deletions(items)) if len(items) > 2 else set())


@functools.lru_cache(maxsize=100_000)
def syllables(word: str) -> tuple[str, ...]:
    """The word cut into known readings, if that is possible, longest first; else the word."""
    known, n = _TABLES["known"], len(word)
    step = [0] * n + [-1]  # length of the first syllable of the rest from here on; 0: the rest cannot be cut
    for i in range(n - 2, -1, -1):
        step[i] = next((k for k in range(min(6, n - i), 1, -1) if step[i + k] and word[i : i + k] in known), 0)
    if not n or not step[0]:
        return (word,)
    out, i = [], 0
    while i < n:
        out.append(word[i : i + step[i]])
        i += step[i]
    return tuple(out)


def _parts(word: str) -> list[str]:
    return [p for chunk in re.split(r"([㐀-鿿𠀀-𳑿])", word) if chunk for p in (syllables(chunk) if not _han(chunk) else (chunk,))]


def _unread(fixed: str, words: list[str]) -> list[str]:
    """Probes with one syllable left out, in any order. A character without a known reading is the one to leave out, so that it meets whatever
    stands in its place; with two or more of them there is nothing to meet by."""
    parts = sorted(p for w in words for p in _parts(w))
    han = [p for p in parts if _han(p)]
    if len(parts) < 2 or len(han) > 1:
        return []
    codes = lambda x: [zlib.crc32(p.encode()) for p in x]
    found = [_whole(codes(p for p in parts if not _han(p)))] if han else deletions(codes(parts))
    return sorted({f"W:{fixed}|{len(parts)}|{h}" for h in found})


class Parsed:
    """What a spelling says: keys (complete spellings; the first is preferred), probes (incomplete ones), and its tokens.

    A spelling that may be either has both, and is incomplete only if a more frequent one completes it. Incomplete spellings with
    the same ``text`` are decided together, and are one entity if nothing completes them. ``alts`` are keys of the spelling with one
    character replaced by one that looks like it.
    """

    def __init__(self, han: bool, keys: list[str], probes: list[str], tokens: list[str], text: str | None = None, alts: list[str] | None = None):
        self.han, self.keys, self.probes, self.tokens, self.text, self.alts = han, keys, probes, tokens, text, alts or []


def _swapped(text: str) -> list[str]:
    return [text[:i] + o + text[i + 1 :] for i, c in enumerate(text) for o in _TABLES["looks"].get(c, [])]


def _plain(name: str) -> str:
    return unicodedata.normalize("NFKC", name).replace("　", " ").strip().translate(_TRADITIONAL)


def parse_broker(name: str) -> Parsed:
    """Stem and line of business. A stem without a line, or behind a nickname's 老, is incomplete."""
    text, alts = _plain(name), []
    if _han(text):
        text = re.sub(r"\s+", "", text)
        turned = re.fullmatch(r"(证券|期货|资本|国际|资管|基金)[（(](.+)[）)]", text)
        if turned:
            text = turned[2] + turned[1]
        for _ in range(3):
            text = _DEPARTMENTS.sub("", text)
        line = next((w for w in LINES if text.endswith(w) and len(text) > len(w) + 1), None)
        stem = text[: -len(line)] if line else text
        if not line and len(stem) > 2 and stem[0] in "老小":
            stem = stem[1:]
        token = "".join(_read(stem))
        line = LINES[line] if line else None
        alts = [f"{''.join(_read(x))}|{line}" for x in _swapped(stem)] if line else []
    else:
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"[-'’]", "", text.lower())) if w and w not in _LEGAL]
        line = next((LATIN_LINES[w] for w in words if w in LATIN_LINES), None)
        token = "".join(w for w in words if w not in LATIN_LINES)
    if not token:
        return Parsed(False, [text.lower()], [], [text.lower()])
    if line:
        return Parsed(_han(name), [f"{token}|{line}"], [], [token, line], alts=alts)
    return Parsed(_han(name), [], sorted({f"B:{d}" for d in left_out(token)}), [token])


def broker_probes(key: str) -> list[str]:
    token, _, line = key.partition("|")
    return [f"T:{d}|{line}" for d in left_out(token)] + [f"B:{d}" for d in left_out(token)] + _unread(line, [token])


def parse_analyst(name: str) -> Parsed:
    """Surname and given name in either order; initials, a given name alone and nicknames with 小 or 老 are incomplete."""
    text = _plain(name)
    for _ in range(3):
        text = _TITLES.sub("", text).strip()
    sur = _surnames()
    if _han(text):
        text = re.sub(r"[\s·]+", "", text)
        n = len(text)
        front = next((k for k in (2, 1) if text[:k] in sur and n > k), 0)
        back = next((k for k in (2, 1) if text[-k:] in sur and n > k), 0)
        cuts = ([(text[:front], text[front:])] if front else []) + ([(text[-back:], text[:-back])] if back else [])
        if not cuts and n > 2:
            cuts = [(text[:1], text[1:])]
        if not cuts:
            # two characters are a given name, or a name whose surname is in no table
            return Parsed(True, [], [f"G:{''.join(_read(text))}"], _read(text), f"{text[0]}|{text[1]}" if n == 2 else None)
        read = lambda family, given: (sur.get(family, "".join(_read(family))), _read(given))
        (s, g), keys = read(*cuts[0]), [f"{s}|{''.join(g)}" for s, g in (read(*c) for c in cuts)]
        given = cuts[0][1]
        if len(given) == 2 and given[0] in "小老阿":
            return Parsed(True, keys, [f"N:{s}|{g[1]}"], [s, g[1]])
        if n == 2:
            return Parsed(True, keys, [f"G:{''.join(_read(text))}"], _read(text))
        return Parsed(True, keys, [], [s, *g], alts=[f"{s}|{''.join(_read(x))}" for x in _swapped(given)])
    dotted = re.findall(r"\b([A-Za-z])\.", text)
    words = [w for w in re.split(r"[^A-Za-z]+", re.sub(r"\b[A-Za-z]\.", " ", text).replace("-", "")) if w]
    if not dotted and len(words) == 2 and not text.isupper():
        short = [w for w in words if re.fullmatch(r"[A-Z]{2}", w)]
        if len(short) == 1:
            dotted = list(short[0])
            words.remove(short[0])
    words = [w.lower() for w in words]
    letters = [c.lower() for c in dotted]
    if not words:
        return Parsed(False, [text.lower()], [], [text.lower()])
    if letters:
        marks = [letters, *([*letters[:k], "?", *letters[k + 1 :]] for k in range(len(letters)))]  # one may stand for a character without a reading
        return Parsed(False, [], [f"I:{''.join(words)}|{''.join(x)}" for x in marks], [*words, *letters])
    known = _TABLES["families"]
    if len(words) == 1:
        cuts = [f"{words[0][:n]}|{words[0][n:]}" for n in range(len(words[0]) - 1, 1, -1) if words[0][:n] in known]
        return Parsed(False, cuts or [f"{words[0]}|"], [], words)
    first, last = (words[0], "".join(words[1:])), (words[-1], "".join(words[:-1]))
    order = sorted((first, last), key=lambda f: (f[0] not in known, not any(len(f[0]) > 3 and one_edit(f[0], k) for k in known)))
    return Parsed(False, [f"{s}|{g}" for s, g in order], [], words)


def analyst_probes(key: str) -> list[str]:
    s, _, g = key.partition("|")
    parts = syllables(g)
    out = [f"T:{s}|{d}" for d in left_out(g)] + [f"T:{d}|{g}" for d in left_out(s)] + [f"G:{g}"]
    if g:
        out += [f"I:{s}|{''.join('?' if _han(p) else p[0] for p in _parts(g))}"]
    if len(parts) > 1:
        out += [f"N:{s}|{p}" for p in parts]
    return sorted(set(out + _unread("", [s, g])))


FIELDS = {"broker": (parse_broker, broker_probes), "analyst": (parse_analyst, analyst_probes)}


def _key_tokens(key: str, field: str) -> list[str]:
    a, _, b = key.partition("|")
    return [a, b] if field == "broker" else [a, *syllables(b)]


def _priced(field: str, left: Column, right: Column):
    """Price of two token strings (joined by blanks): of the tokens as they are, or of words glued in every way that keeps their order."""

    @F.pandas_udf("double")
    def price(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = x.split(" "), y.split(" ")
            forms = [q] if len(q) < 3 else [q, [q[0], "".join(q[1:])]]
            heads = [p] if len(p) < 3 else [p, [p[0], "".join(p[1:])]]
            out.append(min(assignment_price(u, v) for u in heads for v in forms))
        return pd.Series(out, dtype="float64")

    return price(left, right)


def settled(roots: DataFrame, label: str) -> DataFrame:
    """(key, root) with every link followed to its end. Links lead upwards in strength, and each jump doubles the steps taken, so they settle
    within the logarithm of the number of keys; links that still move then go round in a circle, which is an error."""
    roots = materialize(roots, f"{label}0")
    for k in range(roots.count().bit_length() + 2):
        up = roots.select(F.col("key").alias("root"), F.col("root").alias("above"))
        jumped = roots.join(up.hint("merge"), "root", "left").select("key", F.coalesce("above", "root").alias("root"), F.coalesce(F.col("above") != F.col("root"), F.lit(False)).alias("moved"))
        jumped = materialize(jumped, f"{label}{k + 1}")
        roots = jumped.select("key", "root")
        if jumped.where("moved").isEmpty():
            return roots
    raise RuntimeError("links go round in a circle")


def resolve(spellings: DataFrame, contexts: DataFrame, field: str, readings: dict[str, str], surnames: dict[str, str], most: float = 1.5) -> DataFrame:
    """(name, entity) of all spellings that name an entity; ``spellings`` has name and n, ``contexts`` name and ctx.

    A spelling with several readings takes the key that most other spellings support. Keys of Han spellings stand for themselves, but for
    characters mistaken for ones of the same looks. A Latin key joins the Han key, or the more frequent Latin key, of least price up to
    ``most`` that shares a context with it. Incomplete spellings join the proposed entity of least price, then of most shared contexts;
    without any shared context they stay alone, as do spellings that fit nothing. Han keys with characters that are in no table meet each
    other by the same deletions if they have at least three syllables: of two, one replaced character is as often another name.
    No side of a join is broadcast: spellings grow with the data.
    """
    parse, probes_of = FIELDS[field]
    held = spellings.sparkSession.sparkContext.broadcast((readings, surnames))  # at most one entry for each Han character

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use_tables(*held.value)
        for batch in batches:
            rows = [parse(x) for x in batch["name"]]
            yield pd.DataFrame({"name": batch["name"], "unit": [r.text or x for r, x in zip(rows, batch["name"])], "n": batch["n"], "han": [r.han for r in rows], "keys": [r.keys for r in rows], "probes": [r.probes for r in rows], "tokens": [" ".join(r.tokens) for r in rows], "alts": [r.alts for r in rows]})

    names = materialize(spellings.select("name", "n").mapInPandas(parsed, "name string, unit string, n long, han boolean, keys array<string>, probes array<string>, tokens string, alts array<string>"), f"{field}-names")
    options = names.where("size(keys) > 0").select("name", "n", "han", F.size("keys").alias("many"), F.posexplode("keys").alias("at", "key"))
    unread = F.col("key").rlike("[㐀-鿿]")
    # what Han spellings say for a key; of several readings the first counts half
    says = F.when(F.col("many") == 1, F.col("n") + 0.0).when(F.col("at") == 0, F.col("n") / 2)
    han = options.where(F.col("han") & ~unread).groupBy("key").agg(F.sum(says).alias("known")).where("known > 0")
    support = F.coalesce("known", F.lit(0.0))
    pick = Window.partitionBy("name").orderBy(F.when(F.col("han"), support).otherwise((support > 0).cast("double")).desc(), "at")
    keyed = options.join(han.hint("merge"), "key", "left").withColumn("_r", F.row_number().over(pick)).where("_r = 1").select("name", "n", "key", F.col("known").isNotNull().alias("is_han"))
    keyed = materialize(keyed, f"{field}-keyed")
    keys = keyed.groupBy("key").agg(F.sum("n").alias("n"), F.max("is_han").alias("is_han"))

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use_tables(*held.value)
        for batch in batches:
            tokens = [_key_tokens(k, field) for k in batch["key"]]
            parts = [[q for p in t for q in _parts(p)] for t in tokens]
            yield batch.assign(long=[len(_parts(k.split("|")[field == "analyst"])) > 2 for k in batch["key"]], probes=[probes_of(k) for k in batch["key"]], tokens=[" ".join(t) for t in tokens], parts=[" ".join(p) for p in parts])

    index = materialize(keys.mapInPandas(probed, "key string, n long, is_han boolean, long boolean, probes array<string>, tokens string, parts string"), f"{field}-index")
    entries = index.select("key", "n", "is_han", "long", "tokens", "parts", F.explode("probes").alias("probe"))
    # small tables that several steps read are written once, so that no plan repeats another
    contexts = materialize(contexts, f"{field}-contexts")
    ctx_of_key = materialize(contexts.join(keyed.select("name", "key").hint("merge"), "name").select("key", "ctx").distinct(), f"{field}-key-contexts")

    def shared(pairs: DataFrame, left: DataFrame, column: str) -> DataFrame:
        """Number of contexts that each pair (column, target) has in common."""
        right = ctx_of_key.withColumnRenamed("key", "target")
        return pairs.join(left.hint("merge"), column).join(right.hint("merge"), ["target", "ctx"]).groupBy(column, "target").agg(F.count(F.lit(1)).alias("common"))

    def proposed(one: DataFrame, two: DataFrame, tokens: str, upwards: bool = True) -> DataFrame:
        """Pairs of a key and a stronger one (of a Han spelling, or more frequent) with a common probe, priced by their tokens."""
        a, b = one.alias("a"), two.alias("b").hint("merge")
        stronger = F.lit(not upwards) | (F.col("b.is_han") & ~F.col("a.is_han")) | (F.col("b.is_han") == F.col("a.is_han")) & ((F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.key") < F.col("a.key"))))
        met = a.join(b, (F.col("a.probe") == F.col("b.probe")) & (F.col("a.key") != F.col("b.key")) & stronger)
        met = met.select(F.col("a.key").alias("key"), F.col(f"a.{tokens}").alias("ta"), F.col("b.key").alias("target"), F.col(f"b.{tokens}").alias("tb"), F.col("b.n").alias("n"), F.col("b.is_han").alias("is_han")).distinct()
        return met.withColumn("price", _priced(field, F.col("ta"), F.col("tb"))).drop("ta", "tb")

    # Latin keys to stronger ones; Latin keys with a syllable in the place of an unread character to that Han key, and such a Han key
    # to one that is read in full; keys with unread characters among each other
    near = proposed(entries.where(~F.col("is_han") & ~unread & F.col("probe").like("T:%")), entries.where(~unread & F.col("probe").like("T:%")), "tokens")
    holed, whole = entries.where(unread & F.col("probe").like("W:%")), entries.where(~unread & F.col("probe").like("W:%"))
    near = near.unionByName(proposed(whole.where(~F.col("is_han")), holed, "parts", False).withColumn("is_han", F.lit(True)))
    near = near.unionByName(proposed(holed.where("long"), whole.where("is_han"), "parts"))
    kind = entries.where(unread & F.col("long") & F.col("probe").like("T:%"))
    near = near.unionByName(proposed(kind, kind, "tokens"))
    # Han keys to more frequent ones that a character of the same looks makes of them: one edit
    looks = names.select("name", F.explode("alts").alias("target")).join(keyed.select("name", "key").hint("merge"), "name").where("key <> target").select("key", "target").distinct()
    looks = looks.join(index.select("key", F.col("n").alias("own")).hint("merge"), "key").join(index.select(F.col("key").alias("target"), "n", "is_han").hint("merge"), "target").where("n > own")
    near = near.unionByName(looks.select("key", "target", "n", "is_han", F.lit(1.0).alias("price"))).where(F.col("price") <= most)
    near = materialize(near, f"{field}-near")
    near = near.join(shared(near.select("key", "target").distinct(), ctx_of_key, "key").hint("merge"), ["key", "target"])
    best = Window.partitionBy("key").orderBy(F.col("is_han").desc(), "price", F.col("common").desc(), F.col("n").desc(), "target")
    links = near.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("key", "target")
    roots = index.select("key").join(links.hint("merge"), "key", "left").select("key", F.coalesce("target", "key").alias("root"))
    roots = settled(roots, f"{field}-roots")
    complete = keyed.join(roots.hint("merge"), "key").select("name", "n", F.col("root").alias("entity"))
    # incomplete spellings
    loose = names.where("size(probes) > 0").select(F.col("unit").alias("name"), "tokens", "keys", F.explode("probes").alias("probe")).distinct()
    of_unit = contexts.join(names.select("name", "unit").hint("merge"), "name").select(F.col("unit").alias("name"), "ctx").distinct()
    offers = loose.join(entries.select("probe", F.col("key").alias("target"), F.col("tokens").alias("tb")).hint("merge"), "probe").where(~F.array_contains("keys", F.col("target")))
    # a nickname is made of the first character of the given name rather than of a later one
    later = F.max(F.when(F.col("probe").like("N:%") & (F.get(F.split("tb", " "), F.lit(1)) != F.get(F.split("tokens", " "), F.lit(1))), 0.1).otherwise(0.0))
    offers = offers.groupBy("name", "tokens", "target", "tb").agg(later.alias("later"))
    offers = offers.withColumn("price", _priced(field, F.col("tokens"), F.col("tb")) + F.col("later")).where(F.col("price") <= most)
    offers = materialize(offers, f"{field}-offers")
    offers = offers.join(shared(offers.select("name", "target").distinct(), of_unit, "name").hint("merge"), ["name", "target"])
    offers = offers.join(roots.select(F.col("key").alias("target"), F.col("root").alias("entity")).hint("merge"), "target").groupBy("name", "entity").agg(F.min("price").alias("price"), F.max("common").alias("common"))
    offers = offers.join(index.select(F.col("key").alias("entity"), F.col("n").alias("weight")).hint("merge"), "entity")
    best = Window.partitionBy("name").orderBy("price", F.col("common").desc(), "entity")
    partial = offers.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(F.col("name").alias("unit"), F.col("entity").alias("of"), "weight")
    partial = names.where("size(probes) > 0").select("name", "unit", F.element_at("probes", 1).startswith("N:").alias("nick")).join(partial.hint("merge"), "unit").select("name", "nick", "of", "weight")
    # a spelling that may be complete is taken as such unless what would complete it is more frequent (a nickname: as frequent)
    both = complete.join(partial.hint("merge"), "name", "full")
    found = materialize(both.select("name", F.when(F.col("entity").isNull() | (F.col("weight") >= F.col("n") + F.when(F.col("nick"), 0).otherwise(1)), F.col("of")).otherwise(F.col("entity")).alias("entity")), f"{field}-found")
    alone = names.select("name", "unit").join(found.select("name").hint("merge"), "name", "left_anti").select("name", F.concat(F.lit("="), F.col("unit")).alias("entity"))
    return found.unionByName(alone)


def name_entities(raw_reports: DataFrame, readings: dict[str, str] | None = None, surnames: dict[str, str] | None = None) -> DataFrame:
    """(field, name, entity) of broker and analyst spellings; see ``resolve``.

    Null and blank names are left out; broker spellings stay as stored, analyst spellings are split at , ， 、 ; and trimmed. Repeated
    rows only raise counts. An empty input gives an empty result. ``readings`` (character: reading) and ``surnames`` (surname: reading)
    replace the dictionary and the listed surnames; a character without a reading meets a syllable in its place as one edit.
    """
    readings, surnames = tables(raw_reports.sparkSession, readings, surnames)
    held = raw_reports.sparkSession.sparkContext.broadcast((readings, surnames))
    seen = raw_reports.groupBy("ORGAN_NAME", "AUTHOR_NAME").agg(F.count(F.lit(1)).alias("n"))
    author = F.regexp_replace(F.col("a"), r"^[\s　]+|[\s　]+$", "")
    pairs = seen.select(F.col("ORGAN_NAME").alias("org"), "n", F.explode_outer(F.split("AUTHOR_NAME", "[,，、;]")).alias("a")).select("org", "n", F.nullif(author, F.lit("")).alias("author"))
    pairs = materialize(pairs.groupBy("org", "author").agg(F.sum("n").alias("n")), "name-pairs")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use_tables(*held.value)
        for batch in batches:
            yield batch.assign(ctx=[parse_analyst(a).keys or [a] for a in batch["author"]])

    # the analysts of a broker by their reading, as their own spellings vary too
    authors = pairs.where("author is not null").select("author").distinct().mapInPandas(read, "author string, ctx array<string>")
    known_by = pairs.where("org is not null and author is not null").join(authors.hint("merge"), "author").select(F.col("org").alias("name"), F.explode("ctx").alias("ctx")).distinct()
    orgs = pairs.where(F.trim(F.regexp_replace("org", "　", " ")) != "").groupBy(F.col("org").alias("name")).agg(F.sum("n").alias("n"))
    brokers = materialize(resolve(orgs, known_by, "broker", readings, surnames), "brokers")
    homes = pairs.where("author is not null").join(brokers.select(F.col("name").alias("org"), "entity").hint("merge"), "org").select(F.col("author").alias("name"), F.col("entity").alias("ctx")).distinct()
    people = pairs.where("author is not null").groupBy(F.col("author").alias("name")).agg(F.sum("n").alias("n"))
    analysts = resolve(people, homes, "analyst", readings, surnames)
    return brokers.select(F.lit("ORGAN_NAME").alias("field"), "name", "entity").unionByName(analysts.select(F.lit("AUTHOR_NAME").alias("field"), "name", "entity"))


def variant_pairs(entities: DataFrame) -> DataFrame:
    """(field, name_a, name_b), name_a < name_b in code-point order, of two spellings of one entity."""
    entities = materialize(entities, "entities")
    one = entities.select("field", "entity", F.col("name").alias("name_a"))
    two = entities.select("field", "entity", F.col("name").alias("name_b"))
    return one.join(two.hint("merge"), ["field", "entity"]).where("name_a < name_b").select("field", "name_a", "name_b")
