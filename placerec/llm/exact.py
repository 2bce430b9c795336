"""Exact dedup by an exchange of Golomb-coded fingerprints.

Each task gathers runs of up to ``SENDER_ROWS`` rows, a *sender* each: one entry for each different text of the run, with the
ids that have it. A sender's fingerprints of ``FP_BITS`` bits are dealt out to owners by range, sorted, and their gaps are
written as a Golomb-Rice code of some 36 bits each. An owner decodes what all senders sent, and answers each of them with a
bitmap of the entries that another sender has too. Only rows of such suspects, and of entries with several ids, are shuffled
with their bytes: they are grouped by the text itself, partial groups first, so that a text with very many copies is one row
of each task, and a fingerprint that two different texts share makes no group.

What is known of a group goes back to the entries by the text's SHA-256, one row a sender, not one a document: a group that
holds a third of all rows is split by its senders.

Defined results: a null text counts as the empty one; of equal texts the row with the largest id stays, a null id being less
than any other; of rows that share id and text exactly one stays; texts of any length are taken whole; an empty table gives
an empty table; only the id and the text columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerec.llm import textkernel as K
from placerec.llm.shared import cut, maybe_among

FP_BITS, SENDER_ROWS, OWNER_ROWS = 48, 1 << 16, 1 << 18
#: Senders of one task are numbered from the task's number times this.
TASK_SENDERS = 1 << 32


def golomb_encode(values: np.ndarray, low: int, high: int) -> tuple[int, bytes]:
    """The parameter and the code of ascending numbers of [low, high): gaps as unary quotients, then remainders of r bits.

    ``2^r`` is about 0.69 times the mean gap of so many numbers in the range, the best choice for random ones.
    """
    n = len(values)
    r = max(0, int(np.floor(np.log2(max(1.0, 0.69 * (high - low) / max(1, n))))))
    gaps = np.diff(values.astype(np.int64), prepend=low)
    quotients = gaps >> r
    unary = np.ones(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    rest = (gaps[:, None] >> np.arange(r - 1, -1, -1)) & 1
    return r, np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def golomb_decode(code: bytes, n: int, r: int, low: int) -> np.ndarray:
    """The numbers of :func:`golomb_encode`."""
    rest_bytes = (n * r + 7) // 8
    bits = np.frombuffer(code, np.uint8)
    unary = np.unpackbits(bits[: len(bits) - rest_bytes])
    quotients = np.diff(np.flatnonzero(unary == 0)[:n], prepend=-1) - 1
    rest = np.unpackbits(bits[len(bits) - rest_bytes :])[: n * r].reshape(n, r).astype(np.int64)
    gaps = (quotients.astype(np.int64) << r) + (rest << np.arange(r - 1, -1, -1)).sum(1, dtype=np.int64)
    return low + np.cumsum(gaps)


def bounds(owner: int, owners: int) -> tuple[int, int]:
    """The fingerprints of an owner: ranges of equal size."""
    return -(-(owner << FP_BITS) // owners), -(-((owner + 1) << FP_BITS) // owners)


def _entries(sender: int, shas: list[bytes], ids: pa.Array, owners: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A sender's entries in the order of their fingerprints, and the codes that it sends."""
    number: dict[bytes, int] = {}
    entry = np.array([number.setdefault(s, len(number)) for s in shas], np.int64)
    digests = list(number)
    fp = np.array([int.from_bytes(d[:8], "big") >> (64 - FP_BITS) for d in digests], np.int64)
    order = np.argsort(fp, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.argsort(rank[entry], kind="stable")
    sizes = np.bincount(rank[entry], minlength=len(order))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), ids.take(pa.array(by)))
    fp = fp[order]
    owner = np.array([(int(x) * owners) >> FP_BITS for x in fp], np.int32)
    start = np.searchsorted(owner, np.arange(owners + 1))
    pos = np.arange(len(fp)) - start[owner]
    n = len(fp)
    empty = pa.nulls(n, pa.binary())
    columns = [pa.array(np.full(n, sender)), pa.array(owner), pa.array(pos, pa.int32()), pa.array([digests[i] for i in order], pa.binary()), lists, pa.nulls(n, pa.int32()), empty]
    yield pa.RecordBatch.from_arrays(columns, NAMES)
    sent = np.flatnonzero(np.diff(start))
    codes = [golomb_encode(fp[start[o] : start[o + 1]], *bounds(int(o), owners)) for o in sent]
    m = len(sent)
    columns = [pa.array(np.full(m, sender)), pa.array(sent, pa.int32()), pa.array(np.diff(start)[sent], pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.list_(kind)), pa.array([r for r, _ in codes], pa.int32()), pa.array([c for _, c in codes], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, NAMES)


#: Of an entry: pos is its place among the sender's to that owner; of a code: the number of its fingerprints.
NAMES = ["sender", "owner", "pos", "sha", "ids", "rice", "code"]


def send(docs: DataFrame, owners: int, id_col: str, text_col: str, sender_rows: int = SENDER_ROWS) -> DataFrame:
    """Entries (sender, owner, pos, sha, ids) and, where ``code`` is not null, what a sender sends to an owner."""
    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    field = part.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        sender, shas, ids, kind = TaskContext.get().partitionId() * TASK_SENDERS, [], [], None
        for batch in batches:
            kind = batch.column(0).type
            buf, offs = K.flat(batch.column(1))
            view, at = memoryview(buf), offs.tolist()
            shas += [hashlib.sha256(view[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            ids.append(batch.column(0))
            if len(shas) >= sender_rows:
                yield from _entries(sender, shas, pa.concat_arrays(ids), owners, kind)
                sender, shas, ids = sender + 1, [], []
        if shas:
            yield from _entries(sender, shas, pa.concat_arrays(ids), owners, kind)

    return part.mapInArrow(K.releasing(run), f"sender bigint, owner int, pos int, sha binary, ids array<{field}>, rice int, code binary")


def answer(codes: DataFrame, owners: int) -> DataFrame:
    """(sender, owner, bits array of 64 each): the entries whose fingerprint another sender has too; rows without any are left out."""

    def one(key: tuple, sent: pa.Table) -> pa.Table:
        owner = key[0].as_py()
        low = bounds(owner, owners)[0]
        senders, counts = sent.column("sender").to_numpy(), sent.column("pos").to_numpy()
        got = [golomb_decode(c, n, r, low) for c, n, r in zip(sent.column("code").to_pylist(), counts.tolist(), sent.column("rice").to_pylist(), strict=True)]
        fps = np.concatenate([np.zeros(0, np.int64), *got])
        order = np.argsort(fps, kind="stable")
        same = fps[order][1:] == fps[order][:-1]
        twice = np.zeros(len(fps), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at, out = 0, {"sender": [], "bits": []}
        for s, n in zip(senders.tolist(), counts.tolist(), strict=True):
            mine, at = twice[at : at + n], at + n
            if mine.any():
                padded = np.zeros(-(-n // 64) * 64, np.uint8)
                padded[:n] = mine
                out["sender"].append(s)
                out["bits"].append(np.packbits(padded, bitorder="little").view("<i8").tolist())
        return pa.table([pa.array(out["sender"], pa.int64()), pa.array([owner] * len(out["sender"]), pa.int32()), pa.array(out["bits"], pa.list_(pa.int64()))], ["sender", "owner", "bits"])

    return codes.select("sender", "owner", "pos", "rice", "code").groupBy("owner").applyInArrow(one, "sender bigint, owner int, bits array<bigint>")


def verified(docs: DataFrame, suspects: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sha, keep_id, group_size) of texts that several suspect rows have, byte for byte."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    # all rows of one text pass the filter or none does: a row too many is alone in its group
    rows = maybe_among(rows, suspects, "sha", "sha").where("__maybe")
    return rows.groupBy("text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1").select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sender_rows: int = SENDER_ROWS) -> DataFrame:
    """Per row: its id, keep_id, group_size, kept, text_sha256. The rows are counted first: an owner has about ``OWNER_ROWS`` of them."""
    spark = docs.sparkSession
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNER_ROWS))
    sent = cut(send(docs, owners, id_col, text_col, sender_rows), "fingerprints")
    entries, codes = sent.where("code is null").select("sender", "owner", "pos", "sha", "ids"), sent.where("code is not null")
    bits = answer(codes, owners)
    seen = F.getbit(F.element_at("bits", F.floor(F.col("pos") / 64).cast("int") + 1), F.col("pos") % 64) == 1
    marked = entries.join(bits, ["sender", "owner"], "left").select("sender", "sha", "ids", (F.coalesce(seen, F.lit(False)) | (F.size("ids") > 1)).alias("suspect"))
    marked = cut(marked, "suspects")
    suspects, alone = marked.where("suspect"), marked.where("not suspect")
    groups = verified(docs, suspects.select("sha"), id_col, text_col)
    both = suspects.select("sender", "sha", "ids").join(groups, "sha", "left")
    # of rows that share the kept id, the first of the first sender stays
    first = both.where(F.exists("ids", lambda x: x.eqNullSafe(F.col("keep_id")))).groupBy("sha").agg(F.min("sender").alias("home"))
    both = both.join(first, "sha", "left")
    at = F.when((F.col("group_size") > 1) & (F.col("sender") == F.col("home")), _place("ids", "keep_id")).when(F.col("group_size").isNull(), F.lit(0)).otherwise(F.lit(-1))
    many = both.withColumn("at", at).select("sha", "keep_id", "group_size", "at", F.posexplode("ids").alias("n", "id"))
    many = many.select("id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("n") == F.col("at")).alias("kept"), "sha")
    id_alone = F.element_at("ids", 1)
    once = alone.select(id_alone.alias("id"), id_alone.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    out = many.unionByName(once)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _place(ids: str, value: str):
    """The first place of a value, null too, in an array; from 0."""
    return F.array_position(F.transform(ids, lambda x: x.eqNullSafe(F.col(value))), True).cast("int") - 1


#: The same result of the documents table in DuckDB.
ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
