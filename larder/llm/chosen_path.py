"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Sets of the same words
in the same order are one class and are represented by their smallest id.
Representatives descend ``TREES`` independent trees. At a node, a hash of its
path chooses minwise tokens to follow (one, sometimes two: 1 / similarity on
average), and every set goes to the child named by its token. Nodes of up to
``SMALL`` sets are compared exhaustively. In one of more than ``STAR`` sets
every set is first compared with a pivot, the smallest; in one of more than
``SMALL`` with a second, the one most like a few others (sets alike on average
do not part by branching, so their centre is compared with all at once). If
all but ``SMALL`` are then of one component, those few are compared with all;
else the node branches again. What is still large at the last level is
compared in full, share by share, so nothing is capped.

Only sets of different components are compared, since a link within one adds
nothing to the result. Sizes and 32 half-byte minwise sketches say which sets
of a node have a possible partner (``least_agreeing``: a pair at the threshold
agrees in too few places with a chance of ``SKETCH_MISS`` at most). Only these
travel, each once for a block of sets that are compared with one another;
equal blocks of several trees are one. A task counts what the full sets of a
block share, the best partner of each set first, and returns the links that
connect it: no pair is written before it is confirmed, and a block holds at
most ``PER_BLOCK`` shingles, or two parts of a node that has more.

A pair at similarity s is missed by all trees with a chance of
``(1 - s)**TREES`` or less at the first level (6e-9 at 0.85). One whose nodes
stay larger than ``SMALL`` and of many components goes on by branching only:
it is lost before the last level with a chance of 4e-5 at 0.85 and 2e-4 at
0.80, unless a pivot or a chain of other links joins it.

Cases: null and empty texts have no shingles and link with nothing; fewer
words than a shingle are one shingle; rows that repeat an id are one vertex;
rows with a null id are kept and link with nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm import textvec
from larder.llm.common import dropped, text_of, written
from larder.llm.graph import components

SHINGLE, PERCENT = 3, 85
TOKENS, TREES, SMALL, LEVELS = 32, 10, 1024, 4
PLACES, SKETCH_MISS = 32, 2e-6
PER_SALT = 500
#: Nodes of more sets than that are first compared with their pivot.
STAR = 8
#: Sets of a share of a large node, and shingles of a block that is compared exhaustively.
PER_TASK, PER_BLOCK = 4096, 1 << 22

_seeds = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (2, TOKENS + PLACES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(data: np.ndarray, offs: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words, sorted hashes of the distinct shingles) per text."""
    h, ptr, _ = textvec.words(data, offs, fold=True)
    g = textvec.grams(h, n)
    for a, b in zip(ptr[:-1], ptr[1:]):
        w = h[a:b]
        if len(w) >= n:
            yield w, np.unique(g[a:b - n + 1])
        elif len(w):
            yield w, textvec.grams(w, len(w))
        else:
            yield w, w


def _minwise(u: np.ndarray) -> np.ndarray:
    """The smallest scattered hash of a set for each seed."""
    out = np.full(_seeds.shape[1], np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(u), 4096):
        x = u[None, a:a + 4096] * _seeds[0][:, None] + _seeds[1][:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(out, x.min(1), out=out)
    return out


def signatures(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (a hash of the word sequence), sig (its
    minwise tokens), s1 and s2 (half-byte sketches)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textvec.pieces(batches):
            size, keys, sigs, sketches = [], [], [], []
            for w, u in _sets(data, offs, n):
                size.append(len(u))
                keys.append(np.frombuffer(hashlib.blake2b(w.tobytes(), digest_size=16).digest(), np.int64))
                m = _minwise(u)
                sigs.append(m[:TOKENS].astype(np.int64) if len(u) else np.zeros(0, np.int64))
                half = (m[TOKENS:] >> np.uint64(7)) & np.uint64(15)
                sketches.append((half.reshape(2, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).astype(np.int64))
            k, s = np.array(keys), np.array(sketches)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sigs])]), pa.int32()), pa.array(np.concatenate(sigs)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), lists,
                                              pa.array(s[:, 0]), pa.array(s[:, 1])], ["doc_id", "n_shingles", "k1", "k2", "sig", "s1", "s2"])

    d = docs.select("doc_id", text_of().alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(sign, f"doc_id {kind}, n_shingles long, k1 long, k2 long, sig array<long>, s1 long, s2 long")


def full_sets(texts: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(id, items) of (id, text)."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textvec.pieces(batches):
            sets = [u.astype(np.int64) for _, u in _sets(data, offs, n)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["id", "items"])

    return texts.mapInArrow(take, f"id {texts.schema['id'].dataType.simpleString()}, items array<long>")


def least_agreeing(percent: int) -> int:
    """The most places that sketches can be asked to agree in while a pair at
    the threshold fails with a chance of ``SKETCH_MISS`` at most."""
    same = percent / 100 + (1 - percent / 100) / 16  # two half-bytes also agree by chance
    fewer = 0.0
    for k in range(PLACES):
        fewer += math.comb(PLACES, k) * same**k * (1 - same)**(PLACES - k)
        if fewer > SKETCH_MISS:
            return k
    return PLACES


def _children(rows: DataFrame, percent: int) -> DataFrame:
    """The nodes that the sets of a node (path, id, sig, ...) go to."""
    c1 = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(TOKENS)).cast("int")
    c2 = F.pmod(F.xxhash64("path", F.lit(2)), F.lit(TOKENS)).cast("int")
    second = (F.pmod(F.xxhash64("path", F.lit(3)), F.lit(100)) < round(100 * (100 / percent - 1))) & (c1 != c2)
    chosen = F.when(second, F.array(c1, c2)).otherwise(F.array(c1))
    return (rows.withColumn("_c", F.explode(chosen))
            .withColumn("path", F.xxhash64("path", "_c", F.get("sig", F.col("_c")))).drop("_c", "sig"))


def _agreeing(a: Column, b: Column) -> Column:
    """In how many of their 32 places two sketches agree."""
    def apart(k: str) -> Column:
        z = a[k].bitwiseXOR(b[k])
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return PLACES - apart("s1") - apart("s2")


def _close(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches of two struct columns leave a pair possible."""
    a, b = F.col(x), F.col(y)
    sizes = F.least(a["n_shingles"], b["n_shingles"]) * 100 >= F.greatest(a["n_shingles"], b["n_shingles"]) * percent
    return sizes & (_agreeing(a, b) >= least_agreeing(percent))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links. Many pairs may share one ``a``: its
    set is dealt out by salt, so that no task gets them all."""
    # bits of the other side's hash spread the pairs of one ``a``
    often = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_SALT).cast("int").alias("_salts")).select(F.col("a").alias("_a"), "_salts")
    left = (often.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
            .join(sets, F.col("_a") == F.col("id")).select("_a", F.col("_salt").alias("_s"), F.col("items").alias("_left")))
    right = (pairs.join(often, F.col("a") == F.col("_a")).withColumn("_salt", F.pmod(F.xxhash64("b"), F.col("_salts")).cast("int"))
             .select("a", "b", "_salt").join(sets, F.col("b") == F.col("id")).select("a", "b", "_salt", F.col("items").alias("_right")))
    both = right.join(left, (F.col("a") == F.col("_a")) & (F.col("_salt") == F.col("_s")))
    same = both.select("a", "b", F.size(F.array_intersect("_left", "_right")).alias("_i"), (F.size("_left") + F.size("_right")).alias("_n"))
    return same.where((F.col("_i") > 0) & (F.col("_i") * 100 >= (F.col("_n") - F.col("_i")) * percent)).select("a", "b").distinct()


def _runs(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """The groups of rows sorted by ``by``."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in by]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        for x, y in zip([0, *(cuts := np.flatnonzero(new))], [*cuts, batch.num_rows]):
            if x == y:
                continue
            here = tuple(k[x] for k in keys)
            if held and now != here:
                yield pa.Table.from_batches(held)
                held = []
            now = here
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _numbered(rows: pa.Table) -> np.ndarray:
    return rows["comp"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _agreement(rows: pa.Table, asks: np.ndarray, comp: np.ndarray, percent: int) -> np.ndarray:
    """In how many places the sketches of ``asks`` agree with those of all
    rows; -1 where a pair cannot be a link or is of one component."""
    n = rows["n_shingles"].to_numpy()
    s = [rows[c].to_numpy().view(np.uint64) for c in ("s1", "s2")]
    out = np.empty((len(asks), len(n)), np.int8)
    for a in range(0, len(asks), 256):
        x = asks[a:a + 256]
        agree = np.full((len(x), len(n)), PLACES, np.int8)
        for half in s:
            z = half[x][:, None] ^ half[None, :]
            z |= z >> np.uint64(1)
            z |= z >> np.uint64(2)
            agree -= np.bitwise_count(z & np.uint64(0x1111111111111111)).astype(np.int8)
        sizes = np.minimum(n[x][:, None], n[None, :]) * 100 >= np.maximum(n[x][:, None], n[None, :]) * percent
        agree[~sizes | (agree < least_agreeing(percent)) | (comp[x][:, None] == comp[None, :])] = -1
        out[a:a + 256] = agree
    return out


def _due(percent: int):
    """Per (path, _salt), rows sorted by both: the sets that have a possible
    partner of another component (the one or the other in ``_asks``), as
    (block, path, id). A block holds up to ``PER_BLOCK`` shingles; where the
    sets of a node have more, every two of its parts share a block."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "path", "_salt"):
            asks = np.flatnonzero(rows["_asks"].to_numpy(zero_copy_only=False))
            possible = _agreement(rows, asks, _numbered(rows), percent) >= 0
            due = np.union1d(asks[possible.any(1)], np.flatnonzero(possible.any(0)))
            if not len(due):
                continue
            ids = rows["id"].combine_chunks().take(pa.array(due))
            ids = ids.take(pc.sort_indices(ids))
            size = rows["n_shingles"].combine_chunks().take(pa.array(due)).to_numpy()
            part = (np.cumsum(size) - size) // (PER_BLOCK // 2) if size.sum() > PER_BLOCK else np.zeros(len(due), np.int64)
            names = np.unique(part)
            at = {k: np.flatnonzero(part == k) for k in names}
            pairs = [(x, y) for x in names for y in names if x < y] or [(0, 0)]
            for x, y in pairs:
                chosen = ids.take(pa.array(np.union1d(at[x], at[y])))
                block = int.from_bytes(hashlib.blake2b(repr(chosen.to_pylist()).encode(), digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(chosen), pa.int64()),
                                                  pa.array([rows["path"][0].as_py()] * len(chosen), pa.int64()), chosen], ["block", "path", "id"])

    return blocks


def _shared(values: np.ndarray, owner: np.ndarray, m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the sets a[k] and b[k] share: sets as bits, by column blocks."""
    out = np.zeros(len(a), np.int64)
    _, col, times = np.unique(values, return_inverse=True, return_counts=True)
    often = np.cumsum(times > 1) - 1
    of_two = times[col] > 1
    col, owner = often[col[of_two]], owner[of_two]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, 8192):
        x, y = np.searchsorted(col, (low, low + 8192))
        bits = np.zeros((m, 8192 if col[y - 1] - low > 1023 else 1024), bool)
        bits[owner[x:y], col[x:y] - low] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(0, len(a), 8192):
            out[k:k + 8192] += np.bitwise_count(words[a[k:k + 8192]] & words[b[k:k + 8192]]).sum(1, dtype=np.int64)
    return out


def _linked(percent: int):
    """Per block, rows sorted by it: links (a, b) that connect what the links
    between all its sets connect. Each set's most agreeing partner comes
    first, then every possible pair that is still of two components."""
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "block"):
            comp, n = _numbered(rows), rows["n_shingles"].to_numpy()
            every = np.arange(len(n))
            agree = _agreement(rows, every, comp, percent)
            items = rows["items"].combine_chunks()
            values, owner = items.flatten().to_numpy(), np.repeat(every, pc.list_value_length(items).to_numpy())
            found: list[tuple[int, int]] = []
            for first in (True, False):
                if first:
                    a, b = every, agree.argmax(1)
                else:
                    a, b = np.nonzero(np.triu(agree >= 0, 1))
                ok = (agree[a, b] >= 0) & (comp[a] != comp[b])
                a, b = a[ok], b[ok]
                both = _shared(values, owner, len(n), a, b)
                link = (both > 0) & (both * 100 >= (n[a] + n[b] - both) * percent)
                for x, y in zip(a[link], b[link]):
                    if comp[x] != comp[y]:
                        found.append((x, y))
                        comp[comp == comp[y]] = comp[x]
            if found:
                ids = rows["id"].combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([x for x, _ in found])), ids.take(pa.array([y for _, y in found]))], ["a", "b"])

    return links


def _sharing(rows: DataFrame, salts: Column, asks: Column, percent: int, name: str) -> DataFrame:
    """(block, path, id) of the sets with a possible partner, of rows (path,
    comp, id, sizes and sketches) that go to the shares ``salts`` of a node."""
    spark = rows.sparkSession
    dealt = rows.select("path", F.explode(salts).alias("_salt"), asks.alias("_asks"), "comp", "id", "n_shingles", "s1", "s2")
    return written(dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "_salt").sortWithinPartitions("path", "_salt")
                   .mapInArrow(_due(percent), f"block long, path long, id {rows.schema['id'].dataType.simpleString()}"), name)


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("comp", F.col("id"))
    known = labels.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
    return members.join(known, F.col("id") == F.col("_i"), "left").withColumn("comp", F.coalesce("_l", "id")).drop("_i", "_l")


def _centres(members: DataFrame) -> DataFrame:
    """(path, centre): per node the set most like four others drawn by hash."""
    drawn = members.groupBy("path").agg(*[F.min_by("_me", F.xxhash64("path", "id", F.lit(k))).alias(f"_d{k}") for k in range(4)])
    drawn = drawn.withColumnRenamed("path", "_path")
    near = sum((_agreeing(F.col("_me"), F.col(f"_d{k}")) for k in range(1, 4)), _agreeing(F.col("_me"), F.col("_d0")))
    both = members.select("path", "id", "_me").join(drawn, F.col("path") == F.col("_path"))
    return both.groupBy("path").agg(F.max_by("_me", F.struct(near, F.col("id"))).alias("centre"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable),
    kept (the document is that one). Links are pairs whose sets of ``n``-word
    shingles have a Jaccard similarity of ``percent`` or more."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = written(signatures(docs, n), "near-signed")
    linkable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    member = written(linkable.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "rep").distinct(), "near-classes")
    # an id with texts of several classes ties them together
    links = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    reps = written(linkable.join(classes.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "rep"),
                                 (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (F.col("doc_id") == F.col("rep")))
                   .select(F.col("doc_id").alias("id"), "n_shingles", "s1", "s2", "sig"), "near-reps")
    labels, sets, found, tested, old = None, None, [links], [], []
    rows = reps.withColumn("path", F.explode(F.array(*[F.xxhash64(F.lit(f"tree {k}")) for k in range(TREES)])))
    me = F.struct("id", "n_shingles", "s1", "s2")

    def merge(linked: DataFrame) -> None:
        nonlocal labels
        if labels is not None and linked.limit(1).count() == 0:
            return
        found.append(linked)
        every = found[0]
        for x in found[1:]:
            every = every.unionByName(x)
        labels = components(every)
        dropped(spark)

    def settle(pairs: DataFrame) -> None:
        """Confirms pairs and merges what they link."""
        if tested:  # what was refuted is not asked again
            before = tested[0]
            for x in tested[1:]:
                before = before.unionByName(x)
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        if pairs.limit(1).count() > 0:
            tested.append(pairs)
            merge(written(_confirmed(pairs, sets, percent), "near-links"))

    for level in range(1, LEVELS + 1):
        nodes = written(_children(rows, percent), "near-nodes")
        groups = (nodes.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.min(me).alias("pivot"))
                  .where("_n > 1").withColumnRenamed("path", "_path"))
        members = written(nodes.join(groups, F.col("path") == F.col("_path")).drop("_path").withColumn("_me", me), "near-members")
        large = members.where(F.col("_n") > SMALL)
        star = members.where((F.col("_n") > STAR) & _close("_me", "pivot", percent)).select("id", "_me", "pivot")
        compared = members
        if sets is None:
            # small nodes go on with the sets that have a possible partner
            possible = _sharing(_labelled(members.where(F.col("_n") <= SMALL), None), F.array(F.lit(0)), F.lit(True), percent, "near-possible")
            asked = possible.select(F.col("path").alias("_p"), F.col("id").alias("_i")).distinct()
            compared = members.join(asked, (F.col("path") == F.col("_p")) & (F.col("id") == F.col("_i")), "left_semi").unionByName(large)
            # every set that this or a later level may compare
            due = compared.select("id").unionByName(star.select("id")).unionByName(star.select(F.col("pivot.id").alias("id"))).distinct()
            due = written(due, "near-due").withColumnRenamed("id", "_id")
            texts = (docs.select(F.col("doc_id").alias("id"), text_of().alias("text"))
                     .join(due.hint("shuffle_hash"), F.col("id") == F.col("_id"), "left_semi"))
            sets = full_sets(texts, n).dropDuplicates(["id"]).repartition(parts, "id").checkpoint()
        centres = _centres(large).withColumnRenamed("path", "_path")
        star = star.unionByName(large.join(centres, F.col("path") == F.col("_path")).where(_close("_me", "centre", percent))
                                .select("id", "_me", F.col("centre").alias("pivot")))
        settle(star.where(F.col("id") != F.col("pivot.id")).select(F.col("pivot.id").alias("a"), F.col("id").alias("b")).distinct())
        split = _labelled(compared.drop("pivot", "_me", "sig"), labels)
        mixed = split.groupBy("path").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select(F.col("path").alias("_path"))
        split = split.join(mixed, F.col("path") == F.col("_path"), "left_semi")
        # of a large node, the sets outside its largest component
        share = split.where(F.col("_n") > SMALL).groupBy("path", "comp").agg(F.count(F.lit(1)).alias("_k"))
        most = share.groupBy("path").agg(F.max_by("comp", F.struct("_k", "comp")).alias("_main"), (F.sum("_k") - F.max("_k")).alias("_few"))
        split = written(split.join(most.withColumnRenamed("path", "_path"), F.col("path") == F.col("_path"), "left").drop("_path"), "near-split")
        shares, one = F.ceil(F.col("_n") / PER_TASK).cast("int"), F.array(F.lit(0))
        mine = F.pmod(F.xxhash64("id"), shares).cast("int")
        # the few go to each share of their node; at the last level every two shares meet
        outside = F.coalesce(F.col("comp") != F.col("_main"), F.lit(True))
        whole = F.coalesce(F.col("_few") > SMALL, F.lit(False))
        met = F.transform(F.sequence(F.lit(0), shares - 1), lambda k: F.least(k, mine) * shares + F.greatest(k, mine))
        salts = (F.when(F.col("_n") <= SMALL, one).when(whole, met).when(outside, F.sequence(F.lit(0), shares - 1)).otherwise(F.array(mine)))
        now = split if level == LEVELS else split.where(~whole)
        blocks = _sharing(now, salts, whole | outside, percent, "near-blocks").select("block", "id").distinct()
        known = _labelled(reps.drop("sig"), labels)
        known = known.join(sets.select(F.col("id").alias("_i"), "items"), F.col("id") == F.col("_i")).drop("_i")
        merge(written(blocks.withColumnRenamed("id", "_b").join(known, F.col("_b") == F.col("id")).drop("_b")
                      .repartition(parts, "block").sortWithinPartitions("block")
                      .mapInArrow(_linked(percent), links.schema).distinct(), "near-links"))
        dropped(spark, *old)
        old = [nodes, members, split]
        rest = split.where(whole).drop("_n", "comp", "_main", "_few")
        if level == LEVELS or rest.limit(1).count() == 0:
            break
        rows = rest.join(reps.select(F.col("id").alias("_i"), "sig"), F.col("id") == F.col("_i")).drop("_i")
    if labels is None:
        labels = components(links)
    final = _labelled(member.select("doc_id", F.col("rep").alias("id")), labels).groupBy("doc_id").agg(F.min("comp").alias("_comp"))
    out = signed.select("doc_id", "n_shingles").join(final.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d"), "left")
    comp = F.coalesce("_comp", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document stays."""
    gone = near_duplicates(docs, n, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


# Shared shingles counted by an equi-join; components by repeated steps to the smallest id.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END)) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS id, doc_id AS to_id FROM documents UNION SELECT r.id, x.b FROM reach r JOIN both_ways x ON r.to_id = x.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.to_id) AS component_id, d.doc_id = min(r.to_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.id = d.doc_id GROUP BY d.doc_id, n.n
"""
