"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

Words are runs of letters and digits, and runs of punctuation; single words and pairs are
hashed, as are back references (a word equal to the one or the second before it), to ``2**BITS`` weights. A text's features are weighted by SCALE / their number, so a
score is a sparse dot product that does not depend on length. Shards of the labelled sample
are trained side by side and their weights averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text_hash import U64, Quick, byte_table, mix, slabs

BITS, SCALE, SHARDS, EPOCHS = 20, 40.0, 6, 4
BACK = (11, 12, 13, 14)  # buckets of "repeats the last word", "does not", and the same for the second last
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1


def features(texts: list[bytes], rolling: Quick):
    """Hashed unigrams and bigrams of each text, with repetition."""
    for lo, hi in slabs([len(t) for t in texts]):
        part = texts[lo:hi]
        buf = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        kind = np.full(256, 2, dtype=np.uint8)
        kind[[32, *range(9, 14)]] = 0
        kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
        k = kind[buf]
        edge = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        run = k[edge[:-1]] > 0
        starts, ends = edge[:-1][run], edge[1:][run]
        h = rolling.ranges(byte_table()[buf], starts, ends)
        first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in part]))
        one = (h >> U64(64 - BITS)).astype(np.int32)
        two = (mix(h[:-1] * U64(3) + h[1:]) >> U64(64 - BITS)).astype(np.int32)
        back = [np.where(h[n:] == h[:-n], mine, other).astype(np.int32) for n, mine, other in ((1, *BACK[:2]), (2, *BACK[2:]))]
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            yield np.concatenate([one[a:b], two[a : max(a, b - 1)], back[0][a : max(a, b - 1)], back[1][a : max(a, b - 2)]])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """FTRL over (features, label) rows in their order; the last weight is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(EPOCHS):
        for found, label in rows:
            at, times = np.unique(found, return_counts=True)
            at = np.append(at, 1 << BITS)
            x = np.append(times * (SCALE / max(1, len(found))), 1.0)
            w = _weights(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return _weights(z, n)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 12_000) -> np.ndarray:
    """Weights learned from about ``sample`` labelled rows (all, where there are fewer).

    An id with several labels takes the rounded mean; null labels and ids teach nothing. The
    sampled labels are few by that bound, so they are broadcast to the documents.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y")).where("id is not null")
    total = known.count()
    unit = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 40)) / float(1 << 40)
    chosen = known.where(unit < min(1.0, sample / max(1, total)))
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    rows = source.join(F.broadcast(chosen), "id")

    def hashed(batches):
        rolling = Quick()
        for b in batches:
            found = [x.tobytes() for x in features(b["body"].to_pylist(), rolling)]
            yield pa.record_batch([b["id"], b["y"], pa.array(found, pa.binary())], names=["id", "y", "found"])

    def shard(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["id"].to_pylist(), table["y"].to_pylist(), table["found"].to_pylist(), strict=True), key=lambda r: (hash((r[0], 1)), r))
        w = train([(np.frombuffer(f, dtype=np.int32), y) for _, y, f in rows])
        return pa.table({"n": [len(rows)], "w": [w.astype(np.float32).tobytes()]}, schema=pa.schema([("n", pa.int64()), ("w", pa.binary())]))

    sets = rows.mapInArrow(hashed, "id long, y int, found binary").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(SHARDS)))
    parts = sets.groupBy("shard").applyInArrow(shard, "n long, w binary").orderBy("n", "w").collect()
    if not parts:
        return np.zeros((1 << BITS) + 1, dtype=np.float32)
    weight = np.array([p["n"] for p in parts], dtype=np.float64)
    return (np.stack([np.frombuffer(p["w"], dtype=np.float32) for p in parts]).T @ (weight / weight.sum())).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score in 0 to 1 for each row, from the text alone.

    A null or blank text has no features and scores the bias. Ids may be null or repeated. An
    empty table gives an empty result; only the named columns are read. The weights are a
    fixed number of floats, broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    out = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        rolling, w = Quick(), shared.value.astype(np.float64)
        for b in batches:
            dots = [w[-1] + (w[f].sum() * (SCALE / len(f)) if len(f) else 0.0) for f in features(b["body"].to_pylist(), rolling)]
            p = 1 / (1 + np.exp(-np.clip(np.array(dots, dtype=np.float64), -30, 30)))
            yield pa.record_batch([b["id"], pa.array(p, pa.float64())], schema=out)

    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    return source.mapInArrow(run, "id long, score double")
