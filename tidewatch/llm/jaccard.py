"""Exact Jaccard join of whole texts on word n-grams, and the components of its links.

Rare-first prefix filtering.  A set's n-grams are ordered by how often their hash bucket occurs in all
texts (then by hash); two sets that link share one of their first ``n - ceil(t n) + 1``.

1. Equal sets are one class, known by a 64-bit digest.  Only prefix n-grams of two classes or more matter:
   a partial aggregation finds them, a Bloom filter takes them back to the texts.
2. Copies come in large groups, so most links are found without pairing a group's members: every class
   meets, of those that share two of its eight min-hashed prefix n-grams, the plainest, whose prefix has
   the least n-grams of its own; pairs that link give a first labelling by components.  Where a large group
   still meets other labels, those meet its plainest members and some picked by hash.
3. What remains are pairs whose classes have different labels.  Prefix n-grams are counted by pairs of labels
   (a group is one row there) against the lengths and the number that a link needs at least.  Of a large
   group and another label, each class of the latter is then held against the group as a whole: what its
   prefix shares with none of the members is lost to all of them.  Only a class that could still reach what
   a link needs meets the members, and of those only the ones that could reach it, too.
Every pair, wherever it comes from, first meets the length and the positional filter on the shared prefix
n-grams, then, with the sets at hand, the suffix filter (counts by hash range), and last the intersection.

No pair is dropped but by a bound that no link can break.  Texts without words have the empty set and
link with nothing; fewer words than n are one n-gram.  Rows of one id count as one document that has
several texts: each row is listed, with the least id its own text reaches.  Null ids are never the least.
An empty table gives an empty table; other columns, whatever their names, are not read.  A long text's words
are hashed a part at a time; of it, eight bytes for each n-gram are held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.llm.components import components
from tidewatch.llm.sketches import MOST_COUNTS, PIECES, bits_for, bloom, count_of, gather, may_hold, pieces, tally
from tidewatch.llm.texts import map_texts, only, slices
from tidewatch.runtime import cut, release, ship

N, PERCENT = 5, 80
PART = 1_000_000  # characters of a text whose words are held at a time
_BLANK = re.compile(r"[ \n\t]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _parts(text: str) -> Iterator[str]:
    """The text in parts that end at blanks."""
    at = 0
    while len(text) - at > PART:
        border = _BLANK.search(text, at + PART)
        if border is None:
            break
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


class Shingler:
    def __init__(self, n: int = N):
        self.n = n

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct 64-bit n-gram hashes of each text."""
        if any(len(t) > PART for t in texts):
            hashed = [np.concatenate([self._words(p) for p in _parts(t)]) for t in texts]
            sizes, word = [len(h) for h in hashed], np.concatenate(hashed)
        else:
            split = [t.encode().translate(_LOWER).split() for t in texts]
            sizes = [len(ws) for ws in split]
            word = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, sum(sizes))
        gram = word.copy()
        for k in range(1, self.n):
            gram[: max(0, word.size - k)] = gram[: max(0, word.size - k)] * _A + word[k:]
        gram = self._mix(gram)
        out, at = [], 0
        for size in sizes:
            if size >= self.n:
                s = np.sort(gram[at : at + size - self.n + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif size:
                x = word[at : at + 1].copy()
                for k in range(1, size):
                    x = x * _A + word[at + k : at + k + 1]
                out.append(self._mix(x + np.array([size], np.uint64) * _B))
            else:
                out.append(np.zeros(0, np.uint64))
            at += size
        return out

    @staticmethod
    def _words(text: str) -> np.ndarray:
        ws = text.encode().translate(_LOWER).split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * _B
        x = (x ^ (x >> np.uint64(29))) * _A
        return x ^ (x >> np.uint64(32))


def least_kept(size, percent: int = PERCENT):
    """How many of ``size`` members a partner that links must share at least."""
    return -(-percent * size // 100)


def prefix(s: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The rarest n-grams of a set, in order."""
    order = np.lexsort((s, count_of(counts, s)))
    return s[order[: s.size - least_kept(s.size, percent) + 1]]


def _key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class JaccardJoin:
    """The steps of the join over one table of texts."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT):
        self.spark, self.n, self.percent = docs.sparkSession, n, percent
        ship(self.spark)
        self.docs = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), F.xxhash64(docs[id_col]).alias("idh"))
        self.id_type = self.docs.schema["id"].dataType

    def _scan(self, make, schema: T.StructType, rows=None) -> DataFrame:
        """``make(sets)`` -> columns, for each slice of whole texts; ``rows``: a Bloom filter of the id hashes to look at."""
        n, arrow = self.n, to_arrow_schema(schema)

        def run(batches):
            only(None)
            shingler = Shingler(n)
            for batch in batches:
                if rows is not None:
                    batch = batch.filter(pa.array(may_hold(rows.value, batch.column(2).to_numpy(zero_copy_only=False))))
                for _, texts in slices(batch, 1, 1_500_000):
                    columns = make(shingler.sets(texts))
                    if columns is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        return self.docs.mapInArrow(run, schema)

    def rows_and_counts(self) -> tuple[DataFrame, np.ndarray]:
        """(id, key, n) of every row, and how many n-grams of all texts each hash bucket has."""
        schema = T.StructType([T.StructField("id", self.id_type), T.StructField("idh", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), *PIECES])
        arrow = to_arrow_schema(schema)
        n, (chars,) = self.n, self.docs.agg(F.sum(F.length("text"))).first()
        size = 1 << bits_for((chars or 0) // 5, MOST_COUNTS)  # about as many as words

        def run(batches):
            only(None)
            shingler, counts = Shingler(n), np.zeros(size, np.uint8)
            for batch in batches:
                for part, texts in slices(batch, 1, 1_500_000):
                    sets = shingler.sets(texts)
                    tally(counts, np.concatenate(sets))
                    nulls = pa.nulls(len(sets))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([_key(s) for s in sets], pa.int64()), pa.array([s.size for s in sets], pa.int64()), nulls.cast(pa.int32()), nulls.cast(pa.binary())], schema=arrow)
            p = pieces(counts)
            nulls = pa.nulls(p.num_rows)
            yield pa.RecordBatch.from_arrays([nulls.cast(arrow.field(0).type), nulls.cast(pa.int64()), nulls.cast(pa.int64()), nulls.cast(pa.int64()), p.column(0), p.column(1)], schema=arrow)

        both = cut(self.docs.mapInArrow(run, schema), "rows")
        return both.where("n IS NOT NULL").select("id", "idh", "key", "n"), gather(both.where("piece IS NOT NULL").select("piece", "data"), size)

    def keyed(self, rows: DataFrame) -> DataFrame:
        """(_row, _body, _key, _n) of rows given as (_row, _body): the class digest of each."""
        n = self.n

        def work(texts: list[str]) -> list:
            sets = Shingler(n).sets(texts)
            return [[_key(s) for s in sets], [s.size for s in sets]]

        return map_texts(rows, work, [T.StructField("_key", T.LongType()), T.StructField("_n", T.LongType())], "_row", "_body", text_as="_body")

    def prefixes(self, counts, only=None) -> DataFrame:
        """(token, key) of prefix n-grams; with a Bloom filter ``only`` of those that classes share also n, pos, near and far.

        ``far``: how much of the class a set can hold that shares any of these n-grams, all but what stands before
        the first.  ``near``: the same for sets whose size differs by a twentieth at most.  They share k or more,
        since beyond the earlier end of both prefixes there are fewer than t times the larger size; so what
        stands before the k-th and is not shared is lost.  Copies within a slice give one.
        """
        percent, t = self.percent, self.percent / 100
        fields = [T.StructField("token", T.LongType()), T.StructField("key", T.LongType())]
        if only is not None:
            fields += [T.StructField("n", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("pos", "near", "far")]]

        def make(sets):
            by_key = {_key(s): s for s in sets if s.size}
            if not by_key:
                return None
            heads = [prefix(s, counts.value, percent) for s in by_key.values()]
            sizes = [h.size for h in heads]
            token = np.concatenate(heads).view(np.int64)
            key = np.repeat(np.array(list(by_key), np.int64), sizes)
            if only is None:
                return [token, key]
            each = np.array([s.size for s in by_key.values()], np.int64)
            pos = np.concatenate([np.arange(x, dtype=np.int32) for x in sizes])
            ok = may_hold(only.value, token)
            which = np.repeat(np.arange(len(sizes)), sizes)[ok]
            held = np.bincount(which, minlength=len(sizes))
            first, at = np.concatenate([[0], np.cumsum(held)[:-1]]), pos[ok]
            k = np.maximum(1, np.ceil(each * (t * 1.95 / (1 + t) - t) - 1e-6).astype(np.int64))
            pick = lambda i: at[np.minimum(first + i, max(0, at.size - 1))] if at.size else 0
            far = np.where(held > 0, each - pick(0), 0).astype(np.int32)
            near = np.where(held >= k, each - pick(k - 1) - 1 + k, 0).astype(np.int32)
            return [token[ok], key[ok], each[which], at, near[which], far[which]]

        return self._scan(make, T.StructType(fields))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of classes that link."""
        percent = self.percent
        a, b = (self.heads.select(*[F.col(c).alias(c if c == "key" else c + x) for c in self.heads.columns]).withColumnRenamed("key", x) for x in "ab")
        met = pairs.distinct().join(a, "a").join(b, "b").where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
        # positional filter: behind the last shared prefix n-gram there is no more than the shorter rest
        met = met.withColumn("_both", F.array_intersect("tokensa", "tokensb"))
        last = lambda x: F.aggregate(F.arrays_zip(F.col("tokens" + x).alias("t"), F.col("pos" + x).alias("p")), F.lit(-1), lambda m, z: F.when((z["p"] > m) & F.array_contains("_both", z["t"]), z["p"]).otherwise(m))
        total = (F.col("na") + F.col("nb")) * percent
        need = F.floor((total + 99 + percent) / (100 + percent))
        left = F.least(F.col("na") - last("a"), F.col("nb") - last("b")) - 1
        pairs = cut(met.where((F.size("_both") > 0) & (F.size("_both") + F.least(F.col("na"), F.col("nb")) >= need)).where(F.size("_both") + left >= need).select("a", "b"), "pairs")
        if pairs.isEmpty():
            return pairs
        keys = cut(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct().join(self.first_row, "key"), "keys")
        share, n = self.spark.sparkContext.broadcast, keys.count()
        wanted, rows = share(bloom(keys.select("key"), n)), share(bloom(keys.select("idh"), n))
        release(keys)

        def make(sets):
            by_key = {_key(s): s for s in sets if s.size}
            own = np.array(list(by_key), np.int64)
            ok = may_hold(wanted.value, own) if own.size else np.zeros(0, bool)
            return [own[ok], [by_key[k].tobytes() for k in own[ok].tolist()]] if ok.any() else None

        found = cut(self._scan(make, T.StructType([T.StructField("key", T.LongType()), T.StructField("set", T.BinaryType())]), rows), "sets")
        sets = found.groupBy("key").agg(F.first("set").alias("set"))

        def run(batches):
            for batch in batches:
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                ok = [links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a, ok) if k], pa.int64()), pa.array([x for x, k in zip(b, ok) if k], pa.int64())], names=["a", "b"])

        x, y = sets.select(F.col("key").alias("a"), F.col("set").alias("x")), sets.select(F.col("key").alias("b"), F.col("set").alias("y"))
        linked = cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, pairs.schema), "links")
        release(found)
        release(pairs)
        return linked

    def anchors(self, seeds: int = 8) -> DataFrame:
        """(key, own, anchor): min-hashed shared prefix n-grams of each class; ``own``: what share of it stands before them, in thousandths."""
        hashes = self.shared.groupBy("key").agg(F.floor(F.min("pos") * 1000 / F.first("n")).alias("own"), *[F.min(F.xxhash64("token", F.lit(i))).alias(f"h{i}") for i in range(seeds)])
        return hashes.select("key", "own", F.explode(F.array(*[F.xxhash64(f"h{i}", F.lit(i)) for i in range(seeds)])).alias("anchor"))

    def first_pairs(self, anchors: DataFrame, agree: int = 2) -> DataFrame:
        """Each class with the plainest class of its anchors that shares ``agree`` of them."""
        leaders = anchors.groupBy("anchor").agg(F.min(F.struct("own", "key")).alias("top"), F.count("*").alias("c")).where("c > 1").select("anchor", F.col("top.key").alias("a"))
        met = anchors.join(leaders, "anchor").where("key <> a").groupBy("a", F.col("key").alias("b")).agg(F.count("*").alias("c"))
        return met.where(F.col("c") >= agree).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def group_pairs(self, anchors: DataFrame, labels: DataFrame, crowd: int = 16, heads: int = 4) -> DataFrame:
        """Where a large group meets other labels at an anchor: the others with its plainest members there and some picked by hashes."""
        tagged = anchors.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        plain = [F.min(F.struct("own", F.xxhash64("key", F.lit(i)).alias("h"), "key"))["key"] for i in range(heads)]
        some = [F.min(F.struct(F.xxhash64("key", F.lit(i)).alias("h"), "key"))["key"] for i in range(heads)]
        per = tagged.groupBy("anchor", "label").agg(F.count("*").alias("m"), F.array_distinct(F.array(*plain, *some)).alias("heads"))
        large = per.groupBy("anchor").agg(F.count("*").alias("c"), F.max(F.struct("m", "label", "heads")).alias("top")).where((F.col("c") > 1) & (F.col("top.m") >= crowd))
        large = large.select("anchor", F.col("top.label").alias("to"), F.col("top.heads").alias("heads"))
        met = tagged.join(large, "anchor").where("label <> to").select("key", F.explode("heads").alias("head"))
        return met.select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct()

    def rest_pairs(self, labels: DataFrame, crowd: int = 4) -> DataFrame:
        """All pairs of classes with different labels that could link."""
        t, p = self.percent / 100, self.percent
        tagged = cut(self.shared.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")), "tagged")
        mixed = tagged.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
        mixed = cut(tagged.join(mixed, "token"), "mixed")
        release(tagged)
        need = lambda a, b: F.ceil((F.col(a) + F.col(b)) * (t / (1 + t)) - 1e-6)
        groups = mixed.groupBy("token", "label").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("near").alias("near"), F.max("far").alias("far"))
        x, y = groups.alias("x"), groups.alias("y")
        fits = (F.col("x.label") < F.col("y.label")) & (F.col("x.hi") * 100 >= F.col("y.lo") * p) & (F.col("y.hi") * 100 >= F.col("x.lo") * p)
        alike = F.greatest("x.hi", "y.hi") * 0.95 <= F.least("x.lo", "y.lo")
        fits = fits & (F.when(alike, F.least("x.near", "y.near")).otherwise(F.least("x.far", "y.far")) >= need("x.lo", "y.lo"))
        met = x.join(y, F.col("x.token") == F.col("y.token")).where(fits).groupBy(F.col("x.label").alias("la"), F.col("y.label").alias("lb")).agg(F.count("*").alias("c"))
        sizes = mixed.groupBy("label").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_distinct("key").alias("m"))
        for x in "ab":
            met = met.join(sizes.select(F.col("label").alias("l" + x), *[F.col(c).alias(f"{c}_{x}") for c in ("lo", "hi", "m")]), "l" + x)
        # sizes l <= m, l >= t m: overlap >= t (l + m) / (1 + t), of which at most t m lie behind the shorter prefix
        small = F.greatest(F.least("lo_a", "lo_b"), F.ceil(F.greatest("lo_a", "lo_b") * t - 1e-6))
        large = F.least(F.greatest("hi_a", "hi_b"), F.floor(small / t + 1e-6))
        common = F.floor(small * (t / (1 + t)) - large * (t * t / (1 + t)) - 1e-6)
        few = F.struct("m_b", "lb") < F.struct("m_a", "la")  # the label with fewer classes comes first
        side = lambda one, other: F.when(few, F.col(one)).otherwise(F.col(other))
        met = met.where(F.col("c") >= common).select(side("lb", "la").alias("small"), side("la", "lb").alias("large"), side("m_a", "m_b").alias("m"), side("lo_a", "lo_b").alias("lo"), side("hi_a", "hi_b").alias("hi"))
        met = cut(met, "met")
        members = cut(mixed.groupBy("label", "key").agg(F.first("n").alias("n"), F.first("near").alias("near"), F.first("far").alias("far")), "members")
        one = met.join(members.select(F.col("label").alias("small"), F.col("key").alias("a"), *[F.col(c).alias(c + "_a") for c in ("n", "near", "far")]).withColumnRenamed("n_a", "na"), "small")
        alone = one.where(F.col("m") < crowd).select("a", "na", "near_a", "far_a", "large")
        # a class shares k prefix n-grams or more with a set that links: beyond the earlier end of both prefixes there are fewer than t n
        crowded = one.where(F.col("m") >= crowd).withColumn("lo", F.greatest("lo", F.ceil(F.col("na") * t - 1e-6))).withColumn("hi", F.least("hi", F.floor(F.col("na") / t + 1e-6)))
        bound = lambda n: need("na", n) - F.ceil(F.greatest("na", n) * t - 1e-6) + 1
        crowded = crowded.select("a", "na", "large", "lo", F.greatest(F.lit(1), bound("lo")).alias("k_lo"), F.greatest(F.lit(1), bound("hi")).alias("k_hi"))
        shared = groups.select("token", F.col("label").alias("large"))
        against = crowded.join(mixed.select(F.col("key").alias("a"), "token", "pos"), "a").join(shared, ["token", "large"])
        against = against.groupBy("a", "large").agg(F.first("na").alias("na"), F.first("lo").alias("lo"), F.least(F.first("k_lo"), F.first("k_hi")).cast("int").alias("k"), F.sort_array(F.collect_list("pos")).alias("at"))
        # so it loses what stands before its k-th shared one and is shared with no member
        against = against.where(F.size("at") >= F.col("k")).withColumn("far_a", F.col("na") - F.element_at("at", F.col("k")) - 1 + F.col("k")).where(F.col("far_a") >= need("na", "lo"))
        every = alone.unionByName(against.select("a", "na", F.col("far_a").alias("near_a"), "far_a", "large"))
        every = every.join(members.select(F.col("label").alias("large"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("near").alias("near_b"), F.col("far").alias("far_b")), "large")
        alike = F.greatest("na", "nb") * 0.95 <= F.least("na", "nb")
        most = F.when(alike, F.least("near_a", "near_b", "far_a")).otherwise(F.least("far_a", "far_b"))
        every = every.where((F.col("na") * 100 >= F.col("nb") * p) & (F.col("nb") * 100 >= F.col("na") * p) & (most >= need("na", "nb")))
        return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def run(self) -> DataFrame:
        """(id, key, n, label, component) of every row; rows with words link, also by way of others, where their labels are equal."""
        rows, counts = self.rows_and_counts()
        share = self.spark.sparkContext.broadcast
        counts = share(counts)
        tokens = cut(self.prefixes(counts).groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("token"), "tokens")
        only = share(bloom(tokens, tokens.count()))
        release(tokens)
        self.shared = cut(self.prefixes(counts, only).distinct(), "shared")
        self.heads = cut(self.shared.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(F.struct("token", "pos")).alias("l")).select("key", "n", F.col("l.token").alias("tokens"), F.col("l.pos").alias("pos")), "heads")
        self.first_row = rows.groupBy("key").agg(F.min("idh").alias("idh"))
        anchors = cut(self.anchors(), "anchors")
        edges = self.verify(self.first_pairs(anchors))
        labels = cut(components(edges), "labels")
        more = self.verify(self.group_pairs(anchors, labels))
        release(anchors)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            release(labels)
            labels = cut(components(edges), "labels")
        more = self.verify(self.rest_pairs(labels))
        if not more.isEmpty():
            release(labels)
            labels = cut(components(edges.unionByName(more)), "labels")
        named = cut(rows.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")), "named")
        # a written table, not an aggregate, on this side: so Spark can split the rows of a label that has very many
        least = cut(named.where("n > 0").groupBy("label").agg(F.min("id").alias("component")), "least")
        joined = named.join(least, "label", "left")
        return joined.select("id", "key", "n", "label", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def links(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact, with two bounds before the intersection."""
    total = x.size + y.size
    need = -(-percent * total // (100 + percent))  # 100 i >= percent (total - i)
    if not x.size or not y.size or min(x.size, y.size) < need:
        return False
    if total > 256:  # suffix filter: what the hash ranges could share at most
        parts = 64 if total < 4096 else 1024
        shift = np.uint64(64 - parts.bit_length() + 1)
        a, b = (np.bincount((s >> shift).astype(np.int64), minlength=parts) for s in (x, y))
        if int(np.minimum(a, b).sum()) < need:
            return False
    return int(np.isin(x, y, assume_unique=True).sum()) >= need


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    found = JaccardJoin(docs, id_col, text_col).run()
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS t
  FROM (SELECT rid, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
f AS (SELECT t FROM g GROUP BY t HAVING count(*) > 1),
s AS (SELECT rid, t FROM g SEMI JOIN f USING (t)),
p AS (
  SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.t = b.t AND a.rid <> b.rid
  JOIN n x ON x.rid = a.rid JOIN n y ON y.rid = b.rid
  GROUP BY a.rid, b.rid HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
r AS (SELECT a AS k, b AS v FROM p UNION SELECT r.k, p.b FROM r JOIN p ON r.v = p.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(e.doc_id)) AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN r ON r.k = d.rid LEFT JOIN d e ON e.rid = r.v
GROUP BY d.rid, d.doc_id
"""
