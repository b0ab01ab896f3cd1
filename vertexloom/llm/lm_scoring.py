"""LM scoring by prediction by partial matching, beside an add-one unigram base.

``score`` reads the texts in place twice and shuffles counts and rare grams:

1. each task counts its training words and the byte 6-grams of all texts and Spark sums them (the hot ones meet
   pre-summed);
2. every counted gram gets its log probability from the whole trie: grams are dealt by the last two bytes of their
   context, which brings every longer context's edges together; contexts of no or one byte (65,536 edges at most)
   are broadcast. Contexts of more than ``crowd`` grams are dealt by a third byte, then a fourth and a fifth, under which
   256 grams can lie; the edges of these contexts themselves (256 for each of ``SHARE`` contexts at most, at each of three
   lengths) are broadcast too;
3. each task codes its texts and sums the base of common words. The commonest grams with their log probabilities
   (``capacity`` at most, by their count over all texts) and the ``top`` commonest words are broadcast; they hold
   most tokens. The rest, none of which can be hot, meet theirs in a join.

Rows: one for each document. A null text is empty (one token, the end). A null id is learned from. Repeated rows and
ids are separate documents. Columns of the input other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import ppm
from vertexloom.llm._shared import Lookup, arrow_map, holdout, slices, written

BLOCK_WORDS = 300_000
#: Grams that a task of pass 2 has on average.
PART_GRAMS = 1 << 17
#: Grams of one context that stay together: so many, or this share of all if that is more.
CROWD, SHARE = 1 << 13, 1 << 14
COUNTS = "kind int, word binary, gram long, n long, m long"


def _counted(batches):
    """Sums of this task's training words (kind 0) and byte grams (kind 1), given out when they are many: ``n`` in training
    texts, ``m`` in all."""
    words: Counter = Counter()
    grams: list[tuple[np.ndarray, np.ndarray]] = []  # the lowest bit of a key tells held-out texts

    def rows(kind, word, gram, n, m):
        return pa.record_batch([pa.array(np.full(len(n), kind, np.int32)), word, gram, pa.array(n), pa.array(m)], ["kind", "word", "gram", "n", "m"])

    def word_rows():
        k = len(words)
        n = np.fromiter(words.values(), np.int64, k)
        return rows(0, pa.array(list(words), pa.binary()), pa.nulls(k, pa.int64()), n, n)

    def merged():
        keys, n = (np.concatenate([g[i] for g in grams]) for i in (0, 1))
        keys, owner = np.unique(keys, return_inverse=True)
        return keys, np.bincount(owner, n).astype(np.int64)

    def gram_rows(keys, n):
        own, held = (keys >> np.uint64(1)).astype(np.int64), keys & np.uint64(1) == 1
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        return rows(1, pa.nulls(len(first), pa.binary()), pa.array(own[first]), np.add.reduceat(np.where(held, 0, n), first), np.add.reduceat(n, first))

    for batch, texts in slices(batches):
        held = batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)
        buffer, lengths, tokens = ppm.joined(texts)
        for w, out in zip(tokens, held, strict=True):
            if not out:
                words.update(w)
                words[ppm.END] += 1
        keys = ppm.grams(buffer, ppm.positions(lengths)) << np.uint64(1) | np.repeat(held, lengths).astype(np.uint64)
        grams.append(np.unique(keys, return_counts=True))
        if sum(len(g[0]) for g in grams) > 4_000_000:
            grams[:] = [merged()]
            if len(grams[0][0]) > 2_000_000:
                yield gram_rows(*grams.pop())
        if len(words) > BLOCK_WORDS:
            yield word_rows()
            words.clear()
    if words:
        yield word_rows()
    if grams:
        yield gram_rows(*merged())


def _level(gram: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of k bytes with their next symbol, and their counts."""
    keys, owner = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
    return keys, np.bincount(owner, n, len(keys)).astype(np.int64)


def _context(k: int):
    return F.shiftright("gram", 8).bitwiseAND((1 << 8 * k) - 1)


def log_probabilities(grams: DataFrame, crowd: int | None = None) -> DataFrame:
    """gram, m and log, log10 of the last byte's probability under the trie of all contexts that ``n`` counts."""
    short = grams.where("n > 0").groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    gram, n = (short[c].to_numpy() for c in ("gram", "n"))
    total = grams.count()
    model, parts, crowd = {k: _level(gram, n, k) for k in (0, 1)}, 1 + total // PART_GRAMS, crowd or max(CROWD, total // SHARE)
    dealt, deal, crowded = grams, _context(2), {}
    for k in range(2, ppm.ORDER):
        full = dealt if k == 2 else dealt.where(f"crowded{k - 1}")
        found = full.groupBy(_context(k).alias(f"context{k}")).count().where(F.col("count") > crowd).select(f"context{k}")
        found = grams.sparkSession.createDataFrame(found.toPandas(), f"context{k} long")  # ``SHARE`` at most
        if found.isEmpty():
            break
        dealt = dealt.withColumn(f"context{k}", _context(k)).join(F.broadcast(found.withColumn("there", F.lit(True))), f"context{k}", "left").withColumn(f"crowded{k}", F.coalesce("there", F.lit(False))).drop("there")
        edges = dealt.where(f"crowded{k}").where("n > 0").groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
        crowded[k] = tuple(edges[c].to_numpy() for c in ("gram", "n"))
        deal = F.when(F.col(f"crowded{k}"), _context(k + 1) + (k << 48)).otherwise(deal)
    low = grams.sparkSession.sparkContext.broadcast((model, crowded))

    def coded(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        gram, n, m = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in range(3))
        (model, crowded), seen = low.value, n > 0
        levels, keys, counts = dict(model), gram[seen], n[seen]
        for k in range(ppm.ORDER, 1, -1):
            keys, counts = _level(keys, counts, k)
            levels[k] = keys, counts
        for k, (edges, sums) in crowded.items():  # of these contexts a task has a part of the edges only
            near = np.isin(edges >> 8, np.unique((gram >> 8) & ((1 << 8 * k) - 1)))
            own, n_own = levels[k]
            rest = ~np.isin(own >> 8, edges[near] >> 8)
            levels[k] = np.concatenate([own[rest], edges[near]]), np.concatenate([n_own[rest], sums[near]])
        yield pa.record_batch([pa.array(gram), pa.array(m), pa.array(ppm.Trie([levels[k] for k in range(ppm.ORDER + 1)]).code(gram))], ["gram", "m", "log"])

    return arrow_map(dealt.repartition(parts, deal).select("gram", "n", "m"), coded, "gram long, m long, log double")


def common_grams(logs: DataFrame, capacity: int):
    """A condition for the grams with the highest counts, ``capacity`` at most, ties kept or left together."""
    step = F.floor(F.log2("m") * 16).cast("int")  # at most 16 * 63 steps
    least, held = 1 << 30, 0
    for row in sorted(logs.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += row["count"]
        if held > capacity:
            break
        least = row["step"]
    return step >= least


def score(docs: DataFrame, capacity: int = 1 << 20, top: int = 1 << 16, crowd: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes (of the coded stream)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", holdout(F.col("doc_id"), 7).alias("held_out"))
    counts = written(arrow_map(rows.select("text", "held_out"), _counted, COUNTS).groupBy("kind", "word", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    words = counts.where("kind = 0").select("word", "n")
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    whole = size["n"] + size["v"] + 1
    common = {bytes(r["word"]): r["n"] for r in words.orderBy(F.desc("n"), "word").limit(top).collect()}
    logs = written(log_probabilities(counts.where("kind = 1"), crowd))
    often = common_grams(logs, capacity)
    near = logs.where(often).select("gram", "log").toArrow()
    log_of = np.append(near["log"].to_numpy(), 0.0)  # what is not found, at -1, adds nothing here
    model = spark.sparkContext.broadcast((Lookup(near["gram"].to_numpy()), log_of, {w: (np.log10((c + 1) / whole)) for w, c in common.items()}))

    def scored(batches):
        place, log_of, base = model.value
        for batch, texts in slices(batches):
            buffer, lengths, tokens = ppm.joined(texts)
            keys = ppm.grams(buffer, ppm.positions(lengths))
            at, starts = place.find(keys), np.cumsum(lengths) - lengths
            total, far = np.add.reduceat(log_of[at], starts), at < 0
            far_at = np.concatenate([[0], np.cumsum(np.add.reduceat(far.astype(np.int64), starts))])
            grams = pa.ListArray.from_arrays(pa.array(far_at, pa.int32()), pa.array(keys[far].astype(np.int64)))
            known, part, rare_at, rare_words, rare_n = [], [], [0], [], []
            for w in tokens:
                k, b = 0, 0.0
                bag = Counter(w)
                bag[ppm.END] = 1
                for x, n in bag.items():
                    p = base.get(x)
                    if p is None:
                        rare_words.append(x)
                        rare_n.append(n)
                    else:
                        k += n
                        b += n * p
                known.append(k)
                part.append(b)
                rare_at.append(len(rare_words))
            rare = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_n, pa.int64())], ["word", "tf"]))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([len(w) + 1 for w in tokens], pa.int64()), pa.array(known, pa.int64()), pa.array(part, pa.float64()), pa.array(total), pa.array(lengths), rare, grams], ["doc_id", "held_out", "n_tokens", "known", "part", "near", "n_bytes", "rare", "grams"])

    coded = written(arrow_map(rows, scored, "doc_id long, held_out boolean, n_tokens long, known long, part double, near double, n_bytes long, rare array<struct<word: binary, tf: long>>, grams array<long>").withColumn("row", F.monotonically_increasing_id()))
    rare = coded.where(F.size("rare") > 0).select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    c = F.coalesce("n", F.lit(0))
    rest = rare.join(words, "word", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * F.log10((c + 1) / F.lit(float(whole)))).alias("rest"))
    far = coded.where(F.size("grams") > 0).select("row", F.explode("grams").alias("gram")).join(logs.where(~often).select("gram", "log"), "gram").groupBy("row").agg(F.sum("log").alias("far"))
    return coded.drop("rare", "grams").join(rest, "row", "left").join(far, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(size["n"]).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("near") + F.coalesce("far", F.lit(0.0))).alias("score"), "n_bytes",
    )
