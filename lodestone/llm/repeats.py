"""Substrings that occur at two places of a corpus, found by suffix sorting in parts.

Every string of LENGTH bytes has an anchor: the least hash of its ANCHOR-byte strings. Neighbouring
strings with the same anchor form a stretch; equal strings have equal anchors, so a string occurs twice only within
stretches that share an anchor, or in one in which the anchor comes again. Stretches equal as a whole, by a 128-bit BLAKE2 digest of their bytes, are repeats throughout. Where stretches share an anchor and
differ, one of each kind is suffix-sorted with the others (bwt.py) in collections of whole anchors of about BATCH bytes. The
kinds of an anchor with more than MANY of them are parted by longer anchors, up to the whole string, where kinds can't differ any more.

Anchors with a large part of all stretches are named by a frequent-items sketch, and are counted by partial sums and
joined by (anchor, stretch), so that no task gets all of one anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import mapped, settled, stored
from lodestone.llm.pieces import _powers_to, chunks, flat_bytes

LENGTH = 200
ANCHOR = 48
#: Kinds of one anchor that are sorted together at most.
MANY = 256
#: Longer anchors by which the kinds of such an anchor are parted, as shares of the string.
FINER = (0.75, 0.96)
#: Bytes of one collection.
BATCH = 96 << 10
HOT_COUNTERS, HOT_NAMED = 4096, 256

_TABLES = [np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)]
_POSITION = np.uint64((1 << 24) - 1)
#: Bytes of texts that a worker hashes at once (longer texts are taken in parts), and rows that it turns into Python objects at once.
PART, ROWS_AT_ONCE = 1 << 20, 512


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    up, _ = _powers_to(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_TABLES[which][data] * up[: len(data)], out=out[1:])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digests(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers_to(len(sums))
    return _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from running minima forward and backward in blocks of that width."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _cuts(first: np.ndarray, last: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs first to last of strings with one least hash, cut where the anchor that a part began with lies before a string.

    Only where an anchor comes again within a string's length is there anything to cut, as in texts that repeat a few letters over and over.
    """
    long = np.flatnonzero(right[first] < last)
    if not len(long):
        return first, last
    starts, ends = [np.delete(first, long)], [np.delete(last, long)]
    for a, b in zip(first[long].tolist(), last[long].tolist()):
        at = [a]
        while right[at[-1]] < b:
            at.append(int(right[at[-1]]) + 1)
        starts.append(np.array(at))
        ends.append(np.append(np.array(at[1:], np.int64) - 1, b))
    start = np.concatenate(starts)
    order = np.argsort(start, kind="stable")
    return start[order], np.concatenate(ends)[order]


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """(text, start in the text, strings, anchor hash, two halves of the stretch's digest, whether its anchor comes again in it) of texts in one flat array."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none.astype(bool)
    sums = _sums(data, 0)
    at = np.arange(n - anchor + 1)
    hashes = _digests(sums, at, at + anchor)
    least = _least((hashes & ~_POSITION) | (_POSITION - at.astype(np.uint64)), length - anchor + 1)
    right = (_POSITION - (least & _POSITION)).astype(np.int64)  # the rightmost of the least
    key = hashes[right]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(key)]
    good = np.arange(len(key)) + length <= offsets[text + 1]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | ~good[:-1]
    first = np.flatnonzero(new & good)
    last = np.flatnonzero(good & np.append(new[1:] | ~good[1:], True))
    first, last = _cuts(first, last, right)
    raw = memoryview(np.ascontiguousarray(data))
    digests = b"".join([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(first.tolist(), (last + length).tolist())])
    whole = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return text[first], first - offsets[text[first]], last - first + 1, key[first].view(np.int64), whole[:, 0], whole[:, 1], right[first] < right[last]


STRETCH_SCHEMA = "doc_id long, th long, start int, n int, anchor long, whole long, whole2 long, loops boolean"


def _finder(length: int, anchor: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = flat_bytes(batch.column(2))
            for i, j in chunks(offsets, PART):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                long = len(own) > 2 * PART  # one text, taken in parts that overlap by a string less a byte
                for a in range(0, len(own) - length + 1, PART) if long else [0]:
                    part, edges = (own[a : a + PART + length - 1], None) if long else (own, at)
                    text, start, n, *keys = _stretches(part, np.array([0, len(part)]) if long else edges, length, anchor)
                    if len(text):
                        who = pa.array(text + i)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(start + a, pa.int32()), pa.array(n, pa.int32()), *map(pa.array, keys)], names=["doc_id", "th", "start", "n", "anchor", "whole", "whole2", "loops"])

    return run


def _slices(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


CUT_SCHEMA = "anchor long, many boolean, doc_id long, th long, start int, piece binary"


def _piece_cutter(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            rows = []
            for doc, th, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = text.encode()
                rows += [(w["anchor"], w["many"], doc, th, w["start"], raw[w["start"] : w["start"] + w["n"] + length - 1]) for w in wanted]
            if rows:
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["anchor", "many", "doc_id", "th", "start", "piece"])

    return run


SPAN_SCHEMA = "doc_id long, th long, start int, n int"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def _sorter(length: int, limit: int):
    """Rows in the order of anchors -> spans of strings that repeat; collections are whole anchors."""

    def settle(rows):
        import pyarrow as pa

        from lodestone.llm.bwt import repeated

        out = []
        for (_, doc, th, start, _), flags in zip(rows, repeated([r[4] for r in rows], length)):
            out += [(doc, th, start + a, k) for a, k in zip(*(x.tolist() for x in _runs(flags)))]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["doc_id", "th", "start", "n"])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held >= limit and row[0] != rows[-1][0]:
                    yield from settle(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield from settle(rows)

    return run


FINE_SCHEMA = "doc_id long, th long, start int, n int, anchor long, whole long, whole2 long, loops boolean, piece binary"


def _refiner(length: int, anchor: int):
    """Pieces (doc_id, th, start, piece) -> their stretches by longer anchors, with their bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = flat_bytes(batch.column(3))
            for i, j in chunks(offsets, PART):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                piece, start, n, *keys = _stretches(own, at, length, anchor)
                if not len(piece):
                    continue
                who, first = pa.array(piece + i), at[piece] + start
                raw = own.tobytes()
                cut = [raw[f : f + k + length - 1] for f, k in zip(first.tolist(), n.tolist())]
                begin = batch.column(2).to_numpy(zero_copy_only=False)[piece + i] + start
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(begin, pa.int32()), pa.array(n, pa.int32()), *map(pa.array, keys), pa.array(cut, pa.binary())], names=["doc_id", "th", "start", "n", "anchor", "whole", "whole2", "loops", "piece"])

    return run


def _same_doc(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, many: int = MANY) -> DataFrame:
    """Spans of strings of `length` bytes that also start elsewhere, per (doc_id, th): array<struct<start, n>> of first bytes and counts of strings."""
    found = stored(mapped(docs.where(F.octet_length("text") >= length), _finder(length, anchor), STRETCH_SCHEMA), "stretches")
    named = found.agg(F.expr(f"approx_top_k(anchor, {HOT_NAMED}, {HOT_COUNTERS})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    hot = [x["item"] for x in named["top"] or [] if x["count"] * 2 * HOT_COUNTERS > named["n"] and x["count"] > many]
    is_hot = F.col("anchor").isin(hot) if hot else F.lit(False)

    # ordinary anchors: one shuffle by anchor; how often this stretch occurs, and how many kinds of stretches have the anchor
    kind = ["anchor", "whole", "whole2", "loops"]
    place = F.struct("doc_id", "th", "start")
    same, group = Window.partitionBy(*kind), Window.partitionBy("anchor")
    cold = found.where(~is_hot).withColumn("nth", F.row_number().over(same.orderBy("doc_id", "th", "start"))).withColumn("copies", F.count(F.lit(1)).over(same))
    cold = cold.withColumn("kinds", F.count_if(F.col("nth") == 1).over(group)).where("copies > 1 OR kinds > 1 OR loops")
    rows = stored(cold.select("doc_id", "th", "start", "n", "anchor", "copies", "kinds", F.expr("nth = 1 AND (kinds > 1 OR loops)").alias("lead")), "shared")
    if hot:
        kinds = settled(found.where(is_hot).groupBy(*kind).agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("least")))
        kinds = kinds.join(F.broadcast(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).limit(HOT_NAMED)), "anchor")
        warm = found.where(is_hot).join(kinds, kind)
        warm = warm.select("doc_id", "th", "start", "n", "anchor", "copies", "kinds", (((F.col("kinds") > 1) | F.col("loops")) & place.eqNullSafe(F.col("least"))).alias("lead"))
        rows = rows.unionByName(stored(warm.where("copies > 1 OR lead"), "shared"))  # written by itself, so that its join can be split
    whole = rows.where("copies > 1").select("doc_id", "th", "start", "n")

    leads = rows.where("lead").select("doc_id", "th", F.struct("anchor", (F.col("kinds") > many).alias("many"), "start", "n").alias("part"))
    wanted = leads.groupBy("doc_id", "th").agg(F.collect_set("part").alias("wanted"))
    with_text = docs.join(wanted, _same_doc(docs, wanted)).select(docs["doc_id"], docs["th"], "text", "wanted")
    pieces = stored(mapped(with_text, _piece_cutter(length), CUT_SCHEMA), "pieces")
    few = pieces.where("NOT many").select("anchor", "doc_id", "th", "start", "piece")
    todo = pieces.where("many").select("doc_id", "th", "start", "piece")
    for finer in sorted({int(part * length) for part in FINER} | {length}):
        if finer <= anchor or todo.isEmpty():
            continue
        rows = stored(mapped(todo, _refiner(length, finer), FINE_SCHEMA), "finer")
        same = settled(rows.groupBy(*kind).agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("least")))
        per_anchor = settled(same.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))  # written, so that the join by it can be split
        same = same.join(per_anchor, "anchor", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1)))
        lead = ((F.col("kinds") > 1) | F.col("loops")) & place.eqNullSafe(F.col("least"))
        rows = rows.join(same, kind).where("copies > 1 OR kinds > 1 OR loops")
        rows = stored(rows.select("doc_id", "th", "start", "n", "anchor", "copies", "kinds", F.when(lead, F.col("piece")).alias("piece")), "refined")
        whole = whole.unionByName(rows.where("copies > 1").select("doc_id", "th", "start", "n"))
        leads = rows.where("piece IS NOT NULL")
        few = few.unionByName(leads.where(F.col("kinds") <= many).select("anchor", "doc_id", "th", "start", "piece"))
        todo = leads.where(F.col("kinds") > many).select("doc_id", "th", "start", "piece")
    few = few.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "anchor").sortWithinPartitions("anchor")
    spans = mapped(few, _sorter(length, BATCH), SPAN_SCHEMA)
    found = whole.unionByName(spans)
    return found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def covered(size: int, spans, length: int) -> np.ndarray:
    """Sorted (first, end) of maximal removed runs."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    edges = np.array([(s["start"], s["start"] + s["n"] + length - 1) for s in spans], np.int64)
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(edges[:, 1])
    new = np.append(True, edges[1:, 0] > reach[:-1])
    return np.stack([edges[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(edges) - 1)]], axis=1)


REPORT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _reporter(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            out = []
            for doc, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = text.encode()
                runs = covered(len(raw), spans, length)
                digest, at = hashlib.sha256(), 0
                for a, b in runs.tolist():
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((doc, len(raw), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), digest.hexdigest()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def report(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removing bytes covered by strings of `length` bytes that also start elsewhere.

    A null text is empty; texts shorter than `length` keep every byte. Repeated rows repeat each other, so they lose all
    that is long enough. Rows are told apart by id and text, so ids may repeat or be null. Other columns play no part; no
    rows in, no rows out.
    """
    docs = keyed(df, id_col, text_col)
    spans = repeated_spans(docs, length)
    joined = docs.join(spans, _same_doc(docs, spans), "left").select(docs["doc_id"], "text", "spans")
    return mapped(joined, _reporter(length), REPORT_SCHEMA)


def _remover(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            texts = []
            for text, spans in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist()):
                raw = text.encode()
                kept, at = [], 0
                for a, b in covered(len(raw), spans, length).tolist():
                    while a > at and raw[a] & 0xC0 == 0x80:  # never half a letter
                        a -= 1
                    while b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b += 1
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                texts.append(b"".join(kept).decode())
            names = [c for c in batch.schema.names if c not in ("__text", "__spans")]  # n_chars of another kind than numbers stays as it is
            columns = [pa.array(texts, pa.string()) if c == "text" else pa.array([len(t) for t in texts], pa.int64()).cast(batch.schema.field(c).type) if c == "n_chars" and pa.types.is_integer(batch.schema.field(c).type) else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with every repeated string of `length` bytes removed from text (whole letters only) and n_chars, where there is such a column, as it then is.

    Other columns are kept as they are, whatever their names.
    """
    own = keyed(docs, "doc_id", "text")
    spans = repeated_spans(own, length).toDF("__of_id", "__of_th", "__spans")
    marked = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = marked.join(spans, F.col("__th").eqNullSafe(F.col("__of_th")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__of_id")), "left")
    out = joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("text", F.lit("")).alias("__text"), "__spans")
    return mapped(out, _remover(length), docs.schema)
