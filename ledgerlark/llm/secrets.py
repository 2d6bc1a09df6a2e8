"""Secret scans: three base patterns, and a randomness test battery on every other long token.

Battery, for what base spans leave of each token of [A-Za-z0-9+/_=-], from `LEAST` characters on: its encoding is the smallest
of `ALPHABETS` that holds all its characters; a chi-squared test of uniform use of that alphabet, a runs test about the
alphabet's middle and a lag-1 serial correlation test each give a p-value of randomness. None may reject at `ALPHA` / 3. Being
random is not enough for short tokens, so the false discovery rate is held as well. Under the null of ordinary text a character
changes class (lower, upper, digit, sign) with probability `TURN` or words begin with capitals, and letters follow each other as in the shorter tokens of
the table, case aside. The chance of a token as text over its chance as drawn from the alphabets that hold it is a p-value
(by Markov's inequality); Benjamini-Hochberg at `RATE` over all tokens of the table, by a histogram of fixed size, sets the level.

A base span is the whole match (`assign`: from the key word to the end of group 2), in code points, end exclusive.

Edge cases: a null or empty text has no spans; rows with equal doc_id are separate rows; an empty table gives no rows; further
columns are ignored (`redacted` keeps them).
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import saved, small_batches, spans, text_blocks

LEAST, ALPHA, TURN, RATE, BINS = 16, 0.003, 0.08, 0.001, 400
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
KEY_END = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*$")


def _bytes(chars: str) -> np.ndarray:
    gap = np.ones(256, bool)
    gap[np.frombuffer(chars.encode(), np.uint8)] = False
    return gap


_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_TOKEN_GAP = _bytes(_ALNUM + "+/_=-")
_LOW = _ALNUM[:26]
_EITHER = ["0123456789abcdef", _LOW, _LOW + "234567", "0123456789" + _LOW[:22], "0123456789" + _LOW]
#: By size: hexadecimal, letters, both kinds of base32 and base36 in either case; letters, base58, base62 and base64 in both.
ALPHABETS = sorted([c for a in _EITHER for c in (a, a.upper())] + [_ALNUM[:52], "".join(c for c in _ALNUM if c not in "0OIl"), _ALNUM, _ALNUM + "+/"], key=len)
_HOLDS = {c: sum(1 << k for k, a in enumerate(ALPHABETS) if c in a) for c in _ALNUM + "+/"}
_PLACES = [{c: k for k, c in enumerate(a)} for a in ALPHABETS]
_FOLD = str.maketrans("-_", "+/", "=")
#: Letters of either case are 1 to 26, all else is 0; classes are 0 to 3.
_LETTER, _CLASS = np.zeros(256, np.int64), np.full(256, 3)
for _k, _c in enumerate(_LOW):
    _LETTER[[ord(_c), ord(_c.upper())]] = _k + 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_INSIDE = np.log([1.0, 1.0, 0.1, 0.2])  # a character of its class; letters have their pairs
_CAMEL = np.log([[0.85, 0.1, 0.025, 0.025], [0.8, 0.15, 0.025, 0.025], [0.025, 0.025, 0.925, 0.025], [0.3, 0.3, 0.1, 0.3]])
#: Ordinary words, so that small tables have letter pairs too.
WORDS = b"""the of and to in that for with was are this be from which not have their information government development international education national
application management configuration environment description something different through between another without because responsibility understanding
der die das und nicht eine werden haben wurde zwischen verwaltung entwicklung gesellschaft wissenschaft bundesrepublik geschwindigkeit
les des une dans pour qui est sur pas avec plus tout comme gouvernement entreprise connaissance administration quelque toujours
los las del una que con por para como pero desarrollo conocimiento universidad gobierno administracion trabajo siempre
user name file path index value count table width height button content image default python select update string number object"""
_BEFORE = ~_bytes("dtnyDTNY\"' ")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _norm_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson and Hilferty)."""
    z = ((max(x, 1e-9) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return math.erfc(z / math.sqrt(2)) / 2


def letter_pairs(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of (letter, next letter), 0 for the edge of a run of letters, within tokens shorter than LEAST."""
    s, e, _ = spans(buf, off, _TOKEN_GAP)
    keep = e - s < LEAST
    inside = np.zeros(len(buf) + 2, np.int64)
    np.add.at(inside, s[keep] + 1, 1)
    np.add.at(inside, e[keep] + 1, -1)
    x = np.zeros(len(buf) + 2, np.int64)
    x[1:-1] = _LETTER[buf]
    x *= np.cumsum(inside) > 0
    return np.bincount(x[:-1] * 27 + x[1:], minlength=729)


def log_pairs(counts: np.ndarray) -> np.ndarray:
    """Log chances of the next letter by the letter before, where each letter keeps a share of chance."""
    n = counts.reshape(27, 27)[:, 1:] + letter_pairs(np.frombuffer(WORDS, np.uint8), np.array([0, len(WORDS)])).reshape(27, 27)[:, 1:]
    out = np.zeros((27, 27))
    out[:, 1:] = np.log(0.97 * n / np.maximum(1, n.sum(axis=1, keepdims=True)) + 0.03 / 26)
    return out


def text_p(token: str, pairs: np.ndarray) -> float:
    """The p-value of a token as ordinary text."""
    raw = np.frombuffer(token.encode(), np.uint8)
    kind, letter, n = _CLASS[raw], _LETTER[raw], len(raw)
    before = np.r_[0, letter[:-1]]
    turns = int((kind[1:] != kind[:-1]).sum())
    plain = turns * math.log(TURN / 3) + (n - 1 - turns) * math.log(1 - TURN) + float(pairs[before, letter].sum())
    # or words joined with capitals: a capital is mostly followed by small letters and begins a word
    before[1:][(kind[:-1] == 0) & (kind[1:] == 1)] = 0
    camel = float(_CAMEL[kind[:-1], kind[1:]].sum() + pairs[before, letter].sum())
    text = math.log(0.25) + float(_INSIDE[kind].sum() + np.logaddexp(plain, camel)) - math.log(2)
    held = _held(token.translate(_FOLD))
    drawn = [-n * math.log(len(a) if k < len(ALPHABETS) - 1 else 67) for k, a in enumerate(ALPHABETS) if held >> k & 1]
    top = max(drawn)
    return math.exp(min(0.0, text - top - math.log(sum(math.exp(d - top) for d in drawn) / len(ALPHABETS))))


def _held(used: str) -> int:
    """Which alphabets hold all characters, as bits."""
    held = (1 << len(ALPHABETS)) - 1
    for c in set(used):
        held &= _HOLDS[c]
    return held


def battery(token: str) -> bool:
    """Whether the randomness tests let the token pass."""
    used = token.translate(_FOLD)
    if len(used) < 8:
        return False
    held = _held(used)
    k = (held & -held).bit_length() - 1
    x = np.array([_PLACES[k][c] for c in used])
    a, m = len(ALPHABETS[k]), len(used)
    bins = max(2, min(a, m // 5))
    seen = np.bincount(x * bins // a, minlength=bins)
    share = np.bincount(np.arange(a) * bins // a, minlength=bins) / a * m
    p_chi = _chi_tail(float(((seen - share) ** 2 / share).sum()), bins - 1)
    up = x * 2 >= a
    n1, n0 = int(up.sum()), int(m - up.sum())
    if n1 == 0 or n0 == 0:
        return False
    runs = 1 + int((up[1:] != up[:-1]).sum())
    mean = 1 + 2 * n1 * n0 / m
    var = (mean - 1) * (mean - 2) / (m - 1)
    p_runs = _norm_tail((runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    y = x - x.mean()
    power = float((y * y).sum())
    p_serial = _norm_tail(float((y[1:] * y[:-1]).sum()) / power * math.sqrt(m)) if power else 0.0
    return min(p_chi, p_runs, p_serial) > ALPHA / 3


def _level(p: float) -> int:
    """-log10 p in tenths."""
    return min(BINS, int(-10 * math.log10(max(p, 1e-300))))


def scan_text(text: str, pairs: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, bool]]]:
    """Base spans of a text, and (start, end, level, passed) of what they leave of the long tokens."""
    base = base_spans(text)
    tokens = []
    for m in TOKEN.finditer(text):
        at = m.start()
        for s, e in [(s, e) for s, _, e in base if s < m.end() and m.start() < e] + [(m.end(), m.end())]:
            if s - at >= LEAST:
                p = text_p(text[at:s], pairs)
                # no level above RATE is ever accepted
                tokens.append((at, s, _level(p), p <= RATE and battery(text[at:s])))
            at = max(at, e)
    return base, tokens


def suspects(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of a block that can hold any span; the others need no look at their characters one by one."""
    rows = np.zeros(len(off) - 1, bool)
    s, e, _ = spans(buf, off, _TOKEN_GAP)
    rows[np.searchsorted(off, s[e - s >= LEAST], "right") - 1] = True
    at = np.flatnonzero((buf == 58) | (buf == 61))  # : and =
    at = at[at > 0]
    at = at[_BEFORE[buf[at - 1]]]
    if len(at):
        data = buf.tobytes().lower()
        word_end = np.maximum.accumulate(np.where(buf != 32, np.arange(1, len(buf) + 1), 0))  # end of the last byte that is no space
        for p, row in zip(at.tolist(), (np.searchsorted(off, at, "right") - 1).tolist(), strict=True):
            if not rows[row]:
                end = int(word_end[p - 1])
                rows[row] = bool(KEY_END.search(data[max(off[row], end - 12) : max(off[row], end)]))
    return rows


def _pair_counts(batches):
    total = np.zeros(729, np.int64)
    for batch in batches:
        for _, _, buf, off in text_blocks(batch.column(0)):
            total += letter_pairs(buf, off)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def table_pairs(docs: DataFrame) -> np.ndarray:
    """log_pairs of all texts (at most 729 rows come to the driver)."""
    counts = np.zeros(729, np.int64)
    for r in small_batches(docs).select("text").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair] = r.n
    return log_pairs(counts)


def _scan(pairs: np.ndarray):
    def task(batches):
        for batch in batches:
            n = batch.num_rows
            counts, base_text = np.zeros((3, n), np.int64), [""] * n
            found: list[list] = [[] for _ in range(n)]
            for i, j, buf, off in text_blocks(batch.column(1)):
                for r in np.flatnonzero(suspects(buf, off)).tolist():
                    base, tokens = scan_text(buf[off[r] : off[r + 1]].tobytes().decode(), pairs)
                    base_text[i + r] = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                    for _, k, _ in base:
                        counts[k, i + r] += 1
                    found[i + r] = [{"s": s, "k": k, "e": e, "level": -1} for s, k, e in base] + [{"s": s, "k": 3, "e": e, "level": lv} for s, e, lv, ok in tokens if ok]
                    found[i + r] += [{"s": s, "k": 4, "e": e, "level": lv} for s, e, lv, ok in tokens if not ok]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base_text]),
                 pa.array(found, pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int64()), ("e", pa.int64()), ("level", pa.int64())])))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return task


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<s: long, k: long, e: long, level: long>>"


def scanned(docs: DataFrame, pairs: np.ndarray) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(pairs), SCAN)


def discovery_level(scan: DataFrame) -> int:
    """The smallest level that Benjamini-Hochberg accepts, from the histogram of all tokens' levels (at most BINS rows)."""
    levels = scan.select(F.explode("found").alias("f")).where("f.k >= 3").groupBy("f.level").count().collect()
    total = sum(r["count"] for r in levels)
    seen, best = 0, BINS + 1
    for r in sorted(levels, key=lambda r: -r.level):
        seen += r["count"]
        if 10 ** (-r.level / 10) <= RATE * seen / total:
            best = r.level
    return best


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) and n_random of every row."""
    scan = saved(scanned(docs, table_pairs(docs)))
    level = discovery_level(scan)
    names = "array('assign', 'access', 'hex', 'random')"
    kept = scan.withColumn("found", F.expr(f"array_sort(filter(found, f -> f.k < 3 or f.k = 3 and f.level >= {level}))"))
    return kept.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
                       F.expr(f"array_join(transform(found, f -> concat({names}[cast(f.k as int)], ':', f.s, ':', f.e)), ',')").alias("spans"),
                       F.expr("cast(size(filter(found, f -> f.k = 3)) as bigint)").alias("n_random"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by `mark` and n_chars counted anew; other rows and columns stay as they are."""
    pairs = table_pairs(docs)
    level = discovery_level(saved(scanned(docs, pairs)))
    names = docs.columns
    at = names.index("text")

    def task(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, _, buf, off in text_blocks(batch.column(at)):
                for r in np.flatnonzero(suspects(buf, off)).tolist():
                    text = texts[i + r]
                    base, tokens = scan_text(text, pairs)
                    cut = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, lv, ok in tokens if ok and lv >= level])
                    out, past = [], 0
                    for s, e in cut:
                        if s >= past:
                            out += [text[past:s], mark]
                        past = max(past, e)
                    texts[i + r] = "".join(out) + text[past:]
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = [f for f in docs.schema]
    return docs.mapInArrow(task, "struct<" + ", ".join(f"`{f.name}`: {'bigint' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in schema) + ">")
