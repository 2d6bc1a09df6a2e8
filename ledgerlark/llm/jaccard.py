"""N-gram Jaccard join by filtering under several global token orders, and the components of its links.

A document is its set of distinct word shingles; documents of one set are one node. Every order ranks shingles by their class
of frequency (from a count of all shingles in a table of 2**24 places, rarest first) and then by a hash of its own; two sets of
enough overlap share a shingle in their prefixes under every order, so a pair is verified on whole sets only if it does so
under all `ORDERS` orders.

1. Prefixes under the first order are bucketed by shingle; buckets of one node are dropped, and those that no set has so early
   that it could be the smaller one of a pair.
2. Nodes are tried against the head of their largest bucket, the node whose prefix begins most commonly there, so near copies of one
   text link in a number of trials that grows with their number. What links is one part.
3. Nodes of different parts that share prefix shingles become pairs where lengths and positions still allow the overlap: the
   smaller set is looked up by the beginning of its prefix alone, pairs inside the largest part of a bucket are never formed,
   and all shared prefix shingles together must leave room for the overlap.
4. Pairs are verified in blocks of two cells of parts, so a text moves once a block and not once a pair; a pair whose nodes
   are already linked in its block is passed over. A cell holds about `CELL` shingles.
5. Linked nodes are merged round by round, from checkpoint to checkpoint, and each component takes its smallest doc_id.

No link between different texts is lost: a linked pair is in one part, or meets in a bucket of the first order and passes
the others. A bucket is dealt over cells by an estimate of its size, and joins on hot shingles are salted by their counts.

Edge cases: a null, empty or blank text has an empty set, links with nothing and is its own component; fewer words than a
shingle make one shingle of them all; a very long text is one row and one set, whole; rows with equal doc_id stay separate
rows and share what their texts give; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import LOWER, mixed, padded, saved, small_batches, span_hash, spans, text_blocks

ORDERS, TABLE_BITS, CHUNK_BITS = 3, 24, 16
#: Rows of a bucket cell, members a task tries against one node, rows of a hot shingle in one join task, shingles of a block's side.
BUCKET, STAR, HOT, CELL = 4096, 2000, 2000, 100_000
BROADCAST_ROWS = 200_000  # of about 60 bytes
PART = 1 << 18  # bytes of text, or of compressed texts, that a task works on at a time
_SALTS = [np.uint64(0xA0761D6478BD642F * (k + 1) % 2**64) for k in range(ORDERS)]


def sets_of(buf: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    s, e, first = spans(buf, off)
    h = span_hash(padded(LOWER[buf]), s, e)
    grams = h[: max(0, len(h) - size + 1)]
    for k in range(1, size):
        grams = mixed(grams * np.uint64(3)) + h[k : len(h) - size + 1 + k]
    grams = mixed(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            x = np.zeros(min(1, b - a), np.uint64)
            for k in range(a, b):
                x = mixed(x * np.uint64(5) + h[k])
            out.append(x)
    return out


def node_of(x: np.ndarray) -> int:
    """One 64-bit name for a set."""
    return int(np.array([mixed(x).sum() + np.uint64(len(x))], np.uint64).view(np.int64)[0]) if len(x) else 0


class Classes:
    """Frequency classes by shingle, a byte for each place of the table; it travels compressed and is unpacked once a worker."""

    _held: dict = {}

    def __init__(self, table: np.ndarray):
        self.packed = zstandard.ZstdCompressor(level=3).compress(table.tobytes())

    def of(self, x: np.ndarray) -> np.ndarray:
        key = hash(self.packed)
        if key not in Classes._held:
            Classes._held.clear()
            Classes._held[key] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.packed), np.uint8)
        return Classes._held[key][x >> np.uint64(64 - TABLE_BITS)]


def prefix(x: np.ndarray, classes: Classes, order: int, percent: int) -> np.ndarray:
    """The first shingles of a set under an order, as many as no set of enough overlap can miss."""
    rank = mixed(x ^ _SALTS[order]) >> np.uint64(8)
    rank |= classes.of(x).astype(np.uint64) << np.uint64(56)
    n = len(x) - -(-percent * len(x) // 100) + 1
    low = np.argpartition(rank, n - 1)[:n] if n < len(x) else np.arange(len(x))
    return x[low[np.argsort(rank[low])]]


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


class Sets:
    """Sets of compressed texts with what their pairs are filtered by."""

    def __init__(self, classes: Classes, size: int, percent: int):
        self.classes, self.size, self.percent = classes, size, percent

    def unpacked(self, frames: list[bytes]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """(set, sorted prefixes under every order) of each text, worked out about PART bytes at a time."""
        unpack = zstandard.ZstdDecompressor().decompress
        sets: list[np.ndarray] = []
        part: list[bytes] = []
        held = 0
        for k, frame in enumerate(frames, 1):
            part.append(unpack(frame))
            held += len(part[-1])
            if k == len(frames) or held > PART:
                sets += sets_of(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]), self.size)
                part, held = [], 0
        return [(x, [np.sort(prefix(x, self.classes, k, self.percent)) for k in range(ORDERS)] if len(x) else []) for x in sets]

    def links(self, a, b) -> bool:
        """Whether two sets link; whole sets are compared only if they share a prefix shingle under every order."""
        x, y = a[0], b[0]
        if 100 * min(len(x), len(y)) < self.percent * max(len(x), len(y)):
            return False
        if not all(_meet(p, q) for p, q in zip(a[1], b[1], strict=True)):
            return False
        return linked(len(x), len(y), _common(x, y), self.percent)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # merges the two runs
    return int((both[1:] == both[:-1]).sum())


def _meet(x: np.ndarray, y: np.ndarray) -> bool:
    return _common(x, y) > 0


def _frequencies(size: int):
    """Counts of shingles by place in a table, as compressed chunks of 16-bit counts; the table is sent on before one can overflow."""
    def task(batches):
        seen, rows, pack = np.zeros(1 << TABLE_BITS, np.uint16), 0, zstandard.ZstdCompressor(level=1).compress

        def sent():
            for k, part in enumerate(seen.reshape(-1, 1 << CHUNK_BITS)):
                if part.any():
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "counts": [pack(part.tobytes())]})

        for batch in batches:
            for _, _, buf, off in text_blocks(batch.column(0), PART):
                for at in range(0, len(off) - 1, 30_000):
                    part = off[at : at + 30_001]
                    if rows + len(part) > 65_000:
                        yield from sent()
                        seen[:], rows = 0, 0
                    every = np.concatenate(sets_of(buf[part[0] : part[-1]], part - part[0], size))
                    np.add.at(seen, (every >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.uint16(1))
                    rows += len(part)
        if rows:
            yield from sent()
    return task


def _summed(batches):
    """Chunks of counts to one chunk of classes for each number: the count itself up to 128, then eighths of powers of two."""
    total: dict[int, np.ndarray] = {}
    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(unpack(counts.as_py()), np.uint16).astype(np.int64)
    for k, counts in total.items():
        classes = np.where(counts <= 128, counts, 128 + np.minimum(127, 8 * np.log2(np.maximum(counts, 128) / 128)))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "classes": [pack(classes.astype(np.uint8).tobytes())]})


def classes_of(docs: DataFrame, size: int) -> Classes:
    """Frequency classes of shingles by their place in a table of 2**TABLE_BITS counts over all documents (a byte a place is collected)."""
    chunks = docs.select("text").mapInArrow(_frequencies(size), "chunk int, counts binary")
    parts = min(256, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros((1 << TABLE_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    for r in chunks.repartition(parts, "chunk").mapInArrow(_summed, "chunk int, classes binary").collect():
        out[r.chunk] = np.frombuffer(unpack(bytes(r.classes)), np.uint8)
    return Classes(out)


def _first_pass(size: int, classes: Classes, percent: int):
    """Rows to node, set size, prefix under the first order, and over how many cells the bucket of each prefix shingle is dealt."""
    def task(batches):
        for batch in batches:
            for i, j, buf, off in text_blocks(batch.column(1), PART):
                all_sets = sets_of(buf, off, size)
                tokens = [prefix(x, classes, 0, percent) if len(x) else x for x in all_sets]
                bounds = pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
                flat = np.concatenate(tokens)
                c = classes.of(flat).astype(np.float64)
                cells = 1 + (np.where(c <= 128, c, 128 * 2 ** ((c - 128) / 8)) / BUCKET).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([node_of(x) for x in all_sets]), pa.array([len(x) for x in all_sets], pa.int64()),
                     pa.ListArray.from_arrays(bounds, pa.array(flat.view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(cells))], ["doc_id", "node", "n", "p", "cells"])
    return task


def _packed(batches):
    """The rows with their whole text compressed: it is several times smaller to move than the hashes of its set."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            at = part.num_columns - 1
            texts = pa.array([pack(t or b"") for t in part.column(at).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:at], texts], [*part.schema.names[:at], "items"])


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _stars(sets: Sets):
    """Rows (head, salt, lead, node, items), sorted so that each group begins with its lead, to the links of leads."""
    def task(batches):
        now, lead = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            while at < len(rows):
                end, held = at, 0
                while end < len(rows) and held < PART:
                    held += len(rows[end][4])
                    end += 1
                found = []
                for (head, salt, first, node, _), x in zip(rows[at:end], sets.unpacked([r[4] for r in rows[at:end]]), strict=True):
                    if (head, salt) != now:
                        now, lead = (head, salt), (node, x) if first else None
                    elif not first and lead and sets.links(lead[1], x):
                        found.append((lead[0], node))
                if found:
                    yield _links(found)
                at = end
    return task


def _blocks(sets: Sets):
    """Rows (block, other, node, items), sorted so that a block's texts (other is null) precede its pairs, to links."""
    def task(batches):
        now, texts, held, parent = None, {}, None, {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            found = []
            for block, other, node, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    now, texts, held, parent = block, {}, None, {}
                if other is None:
                    texts[node] = items
                    continue
                if held is None:
                    held, texts = dict(zip(texts, sets.unpacked(list(texts.values())), strict=True)), {}
                p, q = top(node), top(other)
                if p != q and sets.links(held[node], held[other]):
                    parent[max(p, q)] = min(p, q)
                    found.append((node, other))
            if found:
                yield _links(found)
    return task


def _texts_of(docs: DataFrame, places: DataFrame, chosen: DataFrame, kinds: str) -> DataFrame:
    """(columns of places, items: compressed text) for places (node, ...) by chosen (node, doc), the row that stands for a node.

    Places are broadcast while there are BROADCAST_ROWS at most, else texts are shuffled by row. A repeated row gives its node
    twice, which later steps bear.
    """
    rows = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), "text")
    side = saved(places.join(chosen.select("node", F.col("doc.doc_id").alias("_doc"), F.col("doc.th").alias("_th")), "node"))
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    found = rows.join(side, rows["_d"].eqNullSafe(side["_doc"]) & (rows["_t"] == side["_th"]))
    return found.select(*places.columns, "text").mapInArrow(_packed, kinds + ", items binary")


def _room(percent: int) -> str:
    """Whether two sets (n, _n) that share a shingle at pos and _pos can still have enough in common."""
    return f"100 * least(n, _n) >= {percent} * greatest(n, _n) and least(n - pos, _n - _pos) >= ceil({percent} * (n + _n) / {100 + percent}.0)"


def _first_tries(rows: DataFrame, percent: int) -> DataFrame:
    """(node, head) from rows (node, n, pos, token, m): each node tries the head of its largest bucket where lengths and positions allow.

    That is the node of a like size with the most common beginning of its prefix; copies with fewest changes are such, and
    most others link with them.
    """
    rows = rows.withColumn("band", F.floor(F.log("n") / np.log(1.25)))
    early = rows.where(_inner(percent))
    weight = early.groupBy("node").agg(F.sum("m").alias("w"), F.max(-F.col("pos")).alias("early"))
    heads = early.select("node", "n", "pos", "token", "band").join(weight, "node").groupBy("token", "band").agg(F.max(F.struct("w", "early", "node", "n", "pos")).alias("h"))
    heads = heads.select("token", "band", F.col("h.node").alias("head"), F.col("h.n").alias("_n"), F.col("h.pos").alias("_pos"))
    fits = rows.join(heads, ["token", "band"]).where(f"node <> head and {_room(percent)}")
    return saved(fits.groupBy("node").agg(F.max(F.struct("m", "head")).alias("h")).select("node", "h.head"))


def _inner(percent: int) -> str:
    """Where the smaller (or equal) set of a linked pair has at least their first shared shingle."""
    return f"n - pos >= ceil(2 * {percent} * n / {100 + percent}.0)"


def _tried(docs: DataFrame, tries: DataFrame, chosen: DataFrame, sets: Sets) -> DataFrame:
    """Links (a: head, b) of tries (node, head)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = tries.groupBy("head").agg((1 + F.floor(F.count(F.lit(1)) / STAR)).alias("groups"))
    members = tries.join(groups, "head").select("head", F.pmod(F.xxhash64("node"), F.col("groups")).alias("salt"), F.lit(False).alias("lead"), "node")
    leads = groups.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"), F.lit(True).alias("lead"), F.col("head").alias("node"))
    rows = _texts_of(docs, members.union(leads), chosen, "head long, salt long, lead boolean, node long")
    return saved(rows.repartition(parts, "head", "salt").sortWithinPartitions("head", "salt", F.desc("lead")).mapInArrow(_stars(sets), "a long, b long"))


def _merged(found: DataFrame) -> DataFrame:
    """(node, to) of what links (a: head, b) merge; a head may have merged into another one itself."""
    to = saved(found.select(F.col("b").alias("node"), F.col("a").alias("to")).distinct())
    for _ in range(2):
        further = to.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        to = to.join(further, "to", "left").select("node", F.coalesce("_to", "to").alias("to"))
    return saved(to)


def links(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) of every row, and links (a, b) between nodes that join what belongs together."""
    spark = docs.sparkSession
    classes = classes_of(docs, size)
    sets = Sets(classes, size, percent)
    first = saved(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")).alias("doc_id"), "text")
                  .mapInArrow(_first_pass(size, classes, percent), "doc_id struct<doc_id: long, th: long>, node long, n long, p array<long>, cells array<int>"))
    # one row stands for a node; node and row are hashed together, so a node of very many copies is no hot key
    chosen = first.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc"))
    lone = first.join(chosen, (first["node"] == chosen["node"]) & first["doc_id"].eqNullSafe(chosen["doc"]), "left_semi")
    rows = lone.select("node", "n", F.posexplode(F.arrays_zip("p", "cells")).alias("pos", "t")).select(
        "node", "n", F.col("pos").cast("int").alias("pos"), F.col("t.p").alias("token"), F.when(F.col("t.cells") > 1, F.pmod(F.xxhash64("node"), F.col("t.cells"))).alias("cell"), F.col("t.cells").alias("cells"))
    seen = "over (partition by token, cell)"
    rows = rows.withColumns({"least": F.expr(f"min(node) {seen}"), "most": F.expr(f"max(node) {seen}"), "m": F.expr(f"count(*) {seen} * cells"), "any": F.expr(f"max({_inner(percent)}) {seen}")})
    counted = saved(rows.where("least <> most and any or cells > 1").drop("least", "most", "any", "cell", "cells"))

    found = _tried(docs, _first_tries(counted, percent), chosen, sets)
    part = saved(counted.select("node", "n").distinct().join(_merged(found), "node", "left").select("node", "n", F.coalesce("to", "node").alias("part")))

    pairs = saved(candidates(counted.select("node", "n", "pos", "token").join(part.select("node", "part"), "node"), percent))
    weight = part.groupBy("part").agg(F.sum("n").alias("_w"))
    cell = part.join(weight, "part").select("node", F.xxhash64("part", F.expr(f"pmod(xxhash64(node), 1 + floor(_w / {CELL}))")).alias("cell"))
    ends = [cell.select(F.col("node").alias(c), F.col("cell").alias(f"_{c}")) for c in "ab"]
    pairs = saved(pairs.join(ends[0], "a").join(ends[1], "b").select(F.xxhash64(F.least("_a", "_b"), F.greatest("_a", "_b")).alias("block"), "a", "b"))
    need = pairs.select("block", F.col("a").alias("node")).union(pairs.select("block", "b")).distinct()
    texts = _texts_of(docs, need, chosen, "block long, node long").select("block", F.lit(None).cast("long").alias("other"), "node", "items")
    work = texts.unionByName(pairs.select("block", F.col("b").alias("other"), F.col("a").alias("node"), F.lit(None).cast("binary").alias("items")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    between = work.repartition(parts, "block").sortWithinPartitions("block", F.col("other").asc_nulls_first(), "node").mapInArrow(_blocks(sets), "a long, b long")
    return first.select("doc_id.doc_id", "node", "n"), saved(found.unionByName(between))


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different parts that the first order lets through, from prefix rows (node, n, pos, token, part).

    The smaller set of a linked pair shares a shingle so early that `inner` holds, so it is looked up by these rows alone. Of
    a bucket's largest part no two nodes are paired: one side is of another part, which the two joins below tell apart.
    A pair's shared prefix shingles are all counted; behind the last of them only the rest of both sets can be shared.
    """
    parts = rows.groupBy("token", "part").agg(F.count(F.lit(1)).alias("_n"))
    dealt = parts.groupBy("token").agg(F.max(F.struct("_n", "part")).alias("h"), F.sum("_n").alias("_m"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
    dealt = dealt.select("token", F.col("h.part").alias("main"), F.expr(f"1 + floor(_m / {HOT})").alias("salts"))
    rows = saved(rows.join(dealt, "token").withColumn("other", F.col("part") != F.col("main"))
                 .withColumn("inner", F.expr(_inner(percent))).drop("main"))
    left = rows.where("other").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts"))).drop("other", "salts")
    right = rows.withColumnsRenamed({c: f"_{c}" for c in ("node", "n", "pos", "part", "inner", "other")}).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    room = f"part <> _part and {_room(percent)}"
    smaller = left.where("inner").join(right, ["token", "salt"]).where(f"{room} and (n < _n or n = _n and (not _other or node < _node))")
    larger = left.join(right.where("_inner and not _other"), ["token", "salt"]).where(f"{room} and _n < n")
    pick = lambda c: F.expr(f"if(node < _node, {c}, _{c})")
    rest = lambda c: F.expr(f"if(node < _node, _{c}, {c})")
    both = smaller.unionByName(larger).select(pick("node").alias("a"), rest("node").alias("b"), pick("n").alias("n"), rest("n").alias("_n"), pick("pos").alias("pos"), rest("pos").alias("_pos"))
    shared = both.groupBy("a", "b", "n", "_n").agg(F.count(F.lit(1)).alias("k"), F.max("pos").alias("pos"), F.max("_pos").alias("_pos"))
    return shared.where(f"k + least(n - pos, _n - _pos) - 1 >= ceil({percent} * (n + _n) / {100 + percent}.0)").select("a", "b")


def _roots(edges: DataFrame) -> DataFrame | None:
    """(node, root) of every node with an edge, or None without edges.

    Each round merges every node into the smallest of its neighbours and then into that one's own; what is left of the edges
    joins the merged nodes. Nodes are hashes, so their order along any chain is random and a round leaves a fraction of it.
    """
    left, steps = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()), []
    while not left.isEmpty():
        least = saved(left.union(left.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to")))
        further = least.select(F.col("node").alias("to"), F.col("to").alias("root"))
        steps.append(saved(least.join(further, "to").select("node", "root")))
        ends = [steps[-1].select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in "ab"]
        moved = left.join(ends[0], "a").join(ends[1], "b").where("_a <> _b")
        left = saved(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if not steps:
        return None
    roots = steps.pop()
    while steps:
        last = roots.select(F.col("node").alias("root"), F.col("root").alias("_last"))
        roots = saved(steps.pop().join(last, "root", "left").select("node", F.coalesce("_last", "root").alias("root")))
    return roots


def components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    rows, edges = links(small_batches(docs), size, percent)
    small = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("id"))
    roots = _roots(edges)
    if roots is None:
        found = small.select(F.col("node").alias("_n"), F.col("id").alias("low"))
    else:
        joined = saved(small.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")))
        lowest = joined.groupBy("root").agg(F.min("id").alias("low"))
        found = joined.join(lowest, "root").select(F.col("node").alias("_n"), "low")
    out = rows.join(found, (rows["node"] == found["_n"]) & (rows["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))
