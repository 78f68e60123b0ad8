"""Near-duplicate documents by HyperMinHash signatures, confirmed on whole shingle sets.

A signature has REGISTERS buckets; a bucket keeps, of its least hash, the count of leading zeros and the MANTISSA bits
after the first one. Each bucket has a hash of its own, so that a set of few shingles fills every bucket and an equal
register is as likely as the sets are alike. BANDS bands of ROWS registers give bucket keys: a pair with similarity 0.8 shares none
of them with probability (1 - 0.8 ** ROWS) ** BANDS, below one in a million.

Equal sets are one node. In each band bucket every node is paired with the least and the greatest node. Pairs whose
estimated similarity, corrected for chance collisions, is in reach of the threshold are confirmed on the full sets, and confirmed links
give components. A bucket that then holds several components is searched whole, in blocks: its nodes outside the first component
against all its nodes of other components, on the full sets where the estimate lets a pair through. So within a bucket no pair that
could still join two components is left out, pairs inside a component are never listed, and only links come out.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import mapped, settled, stored
from lodestone.llm.graphs import components, forest
from lodestone.llm.pieces import chunks, flat_bytes, word_hashes
from lodestone.llm.repeats import _mixed

ROWS, BANDS = 5, 36
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Chance that registers of unlike sets agree: the sum over zero counts of 2 ** -2(z + 1) / 2 ** MANTISSA.
COLLISION = (1 / 3) / (1 << MANTISSA)
#: Standard deviations below the threshold at which an estimate still calls for a look at the sets.
SLACK = 5
#: Nodes of a block when a bucket is searched whole.
BLOCK = 1024
#: Bytes of texts whose sets of words a worker holds at once.
AT_ONCE = 1 << 20

_RNG = np.random.default_rng(7)
_A, _B = (_RNG.integers(1, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1) for _ in range(2))
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after the other, and n+1 offsets."""
    m = len(offsets) - 1
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = word & (edge[:-1] | ~np.append(False, word[:-1]))
    stop = word & (edge[1:] | ~np.append(word[1:], False))
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    words = word_hashes(data, a, b) if len(a) else np.zeros(0, np.uint64)
    bounds = np.searchsorted(a, offsets)
    grams = np.zeros(0, np.uint64)
    if len(words) >= k:
        grams = words[: len(words) - k + 1]
        for i in range(1, k):
            grams = _mixed(grams * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
    parts, counts = [], np.zeros(m, np.int64)
    for t in range(m):
        i, j = int(bounds[t]), int(bounds[t + 1])
        if j - i >= k:
            own = np.sort(grams[i : j - k + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif j > i:  # fewer words than a shingle has: all of them as one
            own = words[i : i + 1]
            for x in words[i + 1 : j]:
                own = _mixed(own * np.uint64(0x9E3779B97F4A7C15) + x)
            own = own ^ np.uint64(0xABCDEF0123456789 + (j - i))
        else:
            continue
        parts.append(own)
        counts[t] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Registers of the sets that aren't empty, uint16."""
    first = offsets[:-1][np.diff(offsets) > 0]
    high, low = (sets >> np.uint64(32)).astype(np.uint32), sets.astype(np.uint32)
    least = np.empty((len(first), REGISTERS), np.uint32)
    buf, more = np.empty_like(high), np.empty_like(high)
    for k in range(REGISTERS):
        np.multiply(high, _A[k], out=buf)
        np.multiply(low, _B[k], out=more)
        np.add(buf, more, out=buf)
        buf ^= buf >> np.uint32(15)
        least[:, k] = np.minimum.reduceat(buf, first)
    _, exponent = np.frexp(least.astype(np.float64))
    zeros = 32 - exponent  # 32 for a hash of 0
    rest = (least.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return (zeros.astype(np.uint64) << np.uint64(MANTISSA) | rest >> np.uint64(32 - MANTISSA)).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    x = registers.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return _mixed((x * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from registers, corrected for chance collisions."""
    return ((a == b).mean(axis=-1) - COLLISION) / (1 - COLLISION)


def _floor(threshold: int) -> float:
    s = threshold / 100
    return s - SLACK * (s * (1 - s) / REGISTERS) ** 0.5


SIGNED_SCHEMA = "doc_id long, th long, n long, d1 long, d2 long, sig binary"


def _signer(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = flat_bytes(batch.column(2))
            for i, j in chunks(offsets, 512 << 10):
                sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n = np.diff(at)
                regs = iter(signatures(sets, at)) if len(sets) else iter(())
                sig, d = [], []
                for t in range(j - i):
                    if n[t]:
                        digest = hashlib.blake2b(sets[at[t] : at[t + 1]].tobytes(), digest_size=16).digest()
                        d.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
                        sig.append(next(regs).tobytes())
                    else:
                        d.append((None, None))
                        sig.append(None)
                d1, d2 = zip(*d)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "th", "n", "d1", "d2", "sig"])

    return run


def _registers(column) -> np.ndarray:
    return np.frombuffer(flat_bytes(column)[0].tobytes(), np.uint16).reshape(-1, REGISTERS)


def _bander(batches):
    import pyarrow as pa

    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            keys = band_keys(_registers(part.column(1))).view(np.int64)
            nodes = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], names=["key", "node"])


def _estimator(floor: float):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if batch.num_rows:
                est = estimated(_registers(batch.column(2)), _registers(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est)], names=["u", "v", "est"]).filter(pc.greater_equal(pa.array(est), floor))

    return run


def _alike(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= threshold * (len(a) + len(b) - shared)


def word_sets(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text as words themselves; with fewer than k words all of them as one."""
    words = text.lower().split()  # of bytes: A-Z alone are lowered, and the six signs of ASCII white space part words
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)} if words else set()


def truly_alike(a: set, b: set, threshold: int) -> bool:
    shared = len(a & b)
    return 100 * shared >= threshold * (len(a) + len(b) - shared)


def _confirmer(k: int, threshold: int):
    """Pairs (u, v, text of u, text of v) whose full sets, compared word by word, are alike enough."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found, sets, held = [], {}, 0
            texts = batch.column(2), batch.column(3)
            for r, pair in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if held > AT_ONCE:
                    sets, held = {}, 0
                for node, text in zip(pair, texts):
                    if node not in sets:
                        raw = text[r].as_buffer().to_pybytes()
                        sets[node] = word_sets(raw, k)
                        held += len(raw)
                if truly_alike(sets[pair[0]], sets[pair[1]], threshold):
                    found.append(pair)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])

    return run


def _searcher(k: int, threshold: int, floor: float):
    """Rows (key, i, j, inner, outer, node, comp, sig, text) in the order of (key, i, j) -> confirmed links that join components.

    Each outer node meets the inner nodes of other components, likeliest first. What a link joins counts as one component
    from then on, and a pair is looked at in the first of the bands it shares only.
    """

    def search(rows):
        key = np.int64(rows[0][0])
        inner, outer = (np.flatnonzero([r[c] for r in rows]) for c in (3, 4))
        node, comp = (np.array([r[c] for r in rows], np.int64) for c in (5, 6))
        sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(sig).view(np.int64)
        sets: dict[int, np.ndarray] = {}

        def of(r: int) -> np.ndarray:
            if r not in sets:
                raw = np.frombuffer(rows[r][8].encode(), np.uint8)
                sets[r] = shingle_sets(raw, np.array([0, len(raw)]), k)[0]
            return sets[r]

        for t in outer.tolist():
            others = inner[comp[inner] != comp[t]]
            est = estimated(sig[others], sig[t])
            good = est >= floor
            others, est = others[good], est[good]
            same = keys[others] == keys[t]
            first = same.argmax(axis=1) if len(others) else np.zeros(0, np.int64)
            here = keys[t][first] == key
            others, est = others[here], est[here]
            for r in others[np.argsort(-est, kind="stable")].tolist():
                if comp[r] != comp[t] and _alike(of(r), of(t), threshold) and truly_alike(word_sets(rows[r][8].encode(), k), word_sets(rows[t][8].encode(), k), threshold):
                    yield min(int(node[r]), int(node[t])), max(int(node[r]), int(node[t]))
                    comp[comp == comp[r]] = comp[t]

    def run(batches):
        import pyarrow as pa

        def out(rows):
            found = list(search(rows))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])

        rows = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(9))):
                if rows and row[:3] != rows[-1][:3]:
                    yield from out(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from out(rows)

    return run


def near_groups(df: DataFrame, shingle: int = 2, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, th (xxhash64 of the text).

    Two documents are linked when 100 * shared >= threshold * all of their distinct shingles of `shingle` words, A-Z
    lower-cased; one with fewer words has all of them as its only shingle. component_id is the least id reachable over links; kept
    says that it is the row's own. Texts without words, and null texts, have no shingles and no links. Rows that repeat
    an id and its set are all kept or all not; a null id is never the least unless its group has no other. Other columns play no part; no rows
    in, no rows out.
    """
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed = stored(mapped(docs, _signer(shingle), SIGNED_SCHEMA), "signed")
    nodes = signed.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least"), F.first("sig").alias("sig"))
    nodes = stored(nodes.select("d1", "d2", F.monotonically_increasing_id().alias("node"), "least.doc_id", "least.th", "sig"), "nodes")

    banded = mapped(nodes.select("node", "sig"), _bander, "key long, node long")
    # what is counted by key is written before it is joined by key: then the join can be split where a bucket is large
    ends = stored(banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high"), "ends")
    buckets = stored(banded.join(ends, "key"), "buckets")
    pairs = buckets.select(F.col("low").alias("u"), F.col("node").alias("v")).unionByName(buckets.select(F.col("node").alias("u"), F.col("high").alias("v"))).where("u < v").distinct()
    members = buckets.select("node").distinct()
    held = nodes.join(members, "node").select("node", "sig", "doc_id", "th")
    texts = docs.join(held, docs["doc_id"].eqNullSafe(held["doc_id"]) & (docs["th"] == held["th"])).select("node", "sig", "text")
    texts = stored(texts, "candidates").dropDuplicates(["node"]) if _repeats(docs, held) else stored(texts, "candidates")

    floor = _floor(threshold)
    sig = texts.select("node", "sig")
    near = pairs.join(sig.toDF("u", "sig_u"), "u").join(sig.toDF("v", "sig_v"), "v").select("u", "v", "sig_u", "sig_v")
    near = stored(mapped(near, _estimator(floor), "u long, v long, est double"), "pairs")

    def confirmed(chosen: DataFrame) -> DataFrame:
        own = texts.select("node", "text")
        rows = chosen.join(own.toDF("u", "text_u"), "u").join(own.toDF("v", "text_v"), "v").select("u", "v", "text_u", "text_v")
        return stored(mapped(rows, _confirmer(shingle, threshold), "u long, v long"), "links")

    # each node with its likeliest partner first: what that joins needs no further look
    by_node = Window.partitionBy("v").orderBy(F.desc("est"), "u")
    best = near.withColumn("nth", F.row_number().over(by_node)).where("nth = 1").select("u", "v")
    comps = settled(forest(confirmed(best)))

    def across(pairs: DataFrame) -> DataFrame:
        """Those of pairs that lie in different components, with the components."""
        of = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias(f"{name}_comp"))
        out = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
        out = out.select("u", "v", F.coalesce("u_comp", "u").alias("cu"), F.coalesce("v_comp", "v").alias("cv"))
        return out.where("cu <> cv")

    def joined(links: DataFrame) -> DataFrame:
        """Components after more links."""
        more = settled(components(across(links).select(F.col("cu").alias("u"), F.col("cv").alias("v"))))
        every = comps.unionByName(more.select("node", F.col("node").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))
        up = more.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        return settled(every.join(up, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp")))

    rest = stored(across(near).select("u", "v"), "rest")
    if not rest.isEmpty():
        comps = joined(confirmed(rest))

    marked = buckets.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = marked.groupBy("key").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last AND n > 3")
    mixed = stored(mixed.select("key", "first", "n"), "mixed")
    open_ = stored(marked.join(mixed, "key"), "open")
    if not open_.isEmpty():
        outer_n = stored(open_.groupBy("key").agg(F.count_if(F.col("comp") != F.col("first")).alias("n_outer")), "outer")
        rows = open_.join(outer_n, "key").select("key", "node", "comp", (F.col("comp") != F.col("first")).alias("minor"), F.ceil(F.col("n") / BLOCK).cast("int").alias("jn"), F.ceil(F.col("n_outer") / BLOCK).cast("int").alias("in"))
        rows = rows.withColumns({c: F.pmod(F.xxhash64("node"), F.col(n)).cast("int") for c, n in (("own_i", "in"), ("own_j", "jn"))})
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        inner = rows.select("key", every("in").alias("i"), F.col("own_j").alias("j"), "node", "comp", "minor", "own_i").select("key", "i", "j", F.lit(True).alias("inner"), (F.col("minor") & (F.col("i") == F.col("own_i"))).alias("outer"), "node", "comp")
        outer = rows.where("minor AND jn > 1").select("key", F.col("own_i").alias("i"), every("jn").alias("j"), "node", "comp", "own_j").where("j <> own_j").select("key", "i", "j", F.lit(False).alias("inner"), F.lit(True).alias("outer"), "node", "comp")
        blocks = inner.unionByName(outer).join(texts, "node").select("key", "i", "j", "inner", "outer", "node", "comp", "sig", "text")
        blocks = blocks.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        found = stored(mapped(blocks, _searcher(shingle, threshold, floor), "u long, v long"), "found")
        if not found.isEmpty():
            comps = joined(found)

    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("component_id")
    heads = nodes.join(comps, "node").groupBy("comp").agg(least)
    of_node = nodes.select("d1", "d2", "node", F.col("doc_id").alias("own_least")).join(comps, "node", "left").join(heads, "comp", "left")
    of_node = of_node.select("d1", "d2", F.when(F.col("comp").isNull(), F.col("own_least")).otherwise(F.col("component_id")).alias("group_id"))
    out = signed.select("doc_id", "th", "n", "d1", "d2").join(of_node, ["d1", "d2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("group_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "th")


def _repeats(docs: DataFrame, held: DataFrame) -> bool:
    """Whether rows repeat an id and text, so that a join by them gives a node more than once."""
    return not docs.groupBy("doc_id", "th").count().where("count > 1").isEmpty()


def keep_one_of_each(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs that near_groups() keeps, one where a row itself is repeated."""
    kept = near_groups(docs, shingle, threshold).where("kept").select(F.col("doc_id").alias("__id"), F.col("th").alias("__of")).distinct()
    marked = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = marked.join(kept, marked["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__of")), "left_semi")
    first = Window.partitionBy("doc_id", "__th").orderBy("doc_id")
    return joined.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
