"""MinHash near-duplicate groups with sequential Bayesian verification.

1. One pass over the texts gives each row its shingle set's digest, size and MinHash signature. Rows with
   equal sets become one class, however many they are.
2. Classes are banded. A bucket's smallest class is its pivot, and pairs are (pivot, member): as many as the
   bucket has rows, never its square.
3. Pairs are verified in batches of signature positions. After each batch the posterior of the similarity
   (uniform prior) is compared with the threshold, and pairs with less than ``miss`` probability of reaching it
   are pruned. What survives is verified exactly on the full shingle sets. The members of a pivot are dealt to stars of
   about ``star`` members, and each star is sent its pivot once, so a pivot with a third of all classes is no one task's
   work and its set is not repeated for each member. A task streams over its stars and holds one pivot.
4. Verified pairs are joined to components. A bucket all of whose classes are in one component is settled. The
   members of the others are gathered by their pivot's component, and those outside it are compared, by the same
   verification, with those inside and with one another. This is done block by block, each task holding two blocks of
   about ``block`` classes and ``block_bytes`` bytes of sets at most and giving only the links it finds. So every two classes that share a bucket end in one
   component or have been compared; nothing is capped, and no table of pairs within groups is made.

Two sets of similarity s share no band with probability ``(1 - s**rows)**bands``: 5e-8 at 0.8 with the defaults.
``threshold`` is a percentage, compared in integers.

Defined cases: a text that is null, empty or without words has an empty set, is linked with nothing and is its
own component; null ids are no component's smallest id (a component of null ids alone has a null id);
repeated rows are equal sets; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, discard, lookup_join, text_chunks, write_table
from .components import connected_components
from .shingles import MinHash, digest, shingle_sets

BATCH = 16


def least_matches(threshold: float, size: int, miss: float, batch: int = BATCH) -> dict[int, int]:
    """After n positions, the fewest equal ones with which a pair goes on: P(s >= threshold | m of n) >= miss."""
    out = {}
    for n in range(batch, size + 1, batch):
        tail, m = 0.0, 0
        for m in range(n + 1):  # the posterior is Beta(m + 1, n - m + 1); its tail is a binomial sum
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
        out[n] = m
    return out


def _binary(column: pa.Array, n: int) -> np.ndarray:
    """A fixed-width view of a binary column of n bytes a row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, n)


def shingle_signatures(docs: DataFrame, keep: list[Column], width: int, size: int) -> DataFrame:
    """``keep``, n_shingles, node (digest of the set) and sig (little-endian low 16 bits of the minima; null for an empty set)."""

    def compute() -> Callable[[list[pa.Array]], list[pa.Array]]:
        hashing = MinHash(size)

        def sign(arrays: list[pa.Array]) -> list[pa.Array]:
            n, node, sig = [], [], []
            for _, _, data, offs in text_chunks(arrays[0]):
                sets = shingle_sets(data, offs, width)
                minima = iter((hashing.signatures([s for s in sets if len(s)]) & np.uint32(0xFFFF)).astype("<u2"))
                n += [len(s) for s in sets]
                node += [digest(s) if len(s) else None for s in sets]
                sig += [next(minima).tobytes() if len(s) else None for s in sets]
            return [pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())]

        return sign

    return arrow_columns(docs, keep, [F.col("text").cast("string")], "n_shingles long, node binary, sig binary", compute)


def _stars(pairs: DataFrame, payload: DataFrame, star: int) -> DataFrame:
    """Rows of the pairs (a, b) by stars: a, part, member (false: the pivot's own row, which comes first), nid and ``payload`` (by nid)."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > star).select("a", F.ceil(F.col("n") / star).cast("int").alias("parts"))
    dealt = lookup_join(pairs, many, "a").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "b")
    members = dealt.select("a", "part", F.lit(True).alias("member"), F.col("b").alias("nid"))
    pivots = dealt.select("a", "part").distinct().select("a", "part", F.lit(False).alias("member"), F.col("a").alias("nid"))
    rows = members.unionByName(pivots).join(payload, "nid").select("a", "part", "member", "nid", *[c for c in payload.columns if c != "nid"])
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "member", "nid")


def _pairs_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _prune(stars: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) of stars with n_shingles and sig that stand all batches."""
    need = least_matches(percent / 100, size, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # signature and size of the pivot of the rows at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            a, member, nid, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "member", "nid", "n_shingles"))
            sig = _binary(batch.column("sig"), 2 * size).view("<u2")
            own = np.flatnonzero(~member)
            leads = np.concatenate([sig[:1] if lead is None else lead[0], sig[own]])
            sizes = np.concatenate([n[:1] if lead is None else lead[1], n[own]])
            of = np.cumsum(~member)  # 0: the pivot of the batch before
            lead = leads[-1:].copy(), sizes[-1:].copy()
            live = np.flatnonzero(member & (100 * np.minimum(n, sizes[of]) >= percent * np.maximum(n, sizes[of])))
            equal = np.zeros(len(live), dtype=np.int64)
            for k, least in need.items():
                equal += (sig[live, k - BATCH : k] == leads[of[live], k - BATCH : k]).sum(axis=1)
                stay = equal >= least
                live, equal = live[stay], equal[stay]
            yield _pairs_of(a[live], nid[live])

    return stars.mapInArrow(run, "a long, b long")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(nid, shingles) of rows (nid, text); shingles as sorted little-endian 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(1)):
                sets = [s.astype("<u8", copy=False).tobytes() for s in shingle_sets(data, offs, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["nid", "shingles"])

    return rows.select("nid", "text").mapInArrow(run, "nid long, shingles binary")


def _shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values of the sorted set x each of the other sets holds."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    at = np.searchsorted(x, every)
    at[at == len(x)] = 0
    return np.add.reduceat((x[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)


def _confirm(stars: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of stars with shingles for which 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, dtype="<u8")
        for batch in batches:
            keep = []
            for member, value in zip(batch.column("member").to_pylist(), batch.column("shingles"), strict=True):
                x = np.frombuffer(value.as_buffer(), dtype="<u8")
                if not member:
                    lead = x.copy()  # the batch goes, its last pivot stays
                both = int(_shared(lead, [x])[0]) if member else 0
                keep.append(member and 100 * both >= percent * (len(lead) + len(x) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "nid")], names=["a", "b"])

    return stars.mapInArrow(run, "a long, b long")


def _compare(left: dict, right: dict, need: dict[int, int], percent: int) -> tuple[list[int], list[int]]:
    """Links between classes of two blocks that lie in different components; one link is enough for two components."""
    a, b, root = [], [], {}

    def top(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    sizes, sigs = np.array([len(x) for x in right["set"]]), right["sig"]
    for nid, comp, x, sig in zip(left["nid"], left["component"], left["set"], left["sig"], strict=True):
        fits = 100 * np.minimum(sizes, len(x)) >= percent * np.maximum(sizes, len(x))
        live = np.flatnonzero(fits & (right["component"] != comp))
        equal = np.zeros(len(live), dtype=np.int64)
        for n, least in need.items():
            if not len(live):
                break
            equal += (sigs[live, n - BATCH : n] == sig[n - BATCH : n]).sum(axis=1)
            stay = equal >= least
            live, equal = live[stay], equal[stay]
        for lo in range(0, len(live), 256):  # once linked to a component, its other members need no look
            some = [k for k in live[lo : lo + 256].tolist() if top(int(right["component"][k])) != top(int(comp))]
            if not some:
                continue
            both = _shared(x, [right["set"][k] for k in some])
            for k, n in zip(some, both.tolist(), strict=True):
                if 100 * n >= percent * (len(x) + sizes[k] - n):
                    a.append(int(nid))
                    b.append(int(right["nid"][k]))
                    root[top(int(comp))] = top(int(right["component"][k]))
    return a, b


def _blocks(rows: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """(hub, o, j, right, nid, component) from (hub, nid, component, n_shingles): classes outside the hub against all of it, in blocks.

    Outsiders are dealt to blocks o, insiders to blocks j and outsiders to further blocks j; a task (hub, o, j) has
    block o on the left and block j on the right.
    """
    inside = F.col("component") == F.col("hub")
    held = lambda c: F.sum(F.when(c, 8 * F.col("n_shingles")).otherwise(0))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(block)), F.ceil(size / F.lit(block_bytes))).cast("int")
    counts = rows.groupBy("hub").agg(blocks(F.count_if(inside), held(inside)).alias("km"), blocks(F.count_if(~inside), held(~inside)).alias("ko"), F.count_if(~inside).alias("k")).where("k > 0").drop("k")
    r = lookup_join(rows, counts, "hub").where("km IS NOT NULL")
    deal = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
    all_o, all_j = F.sequence(F.lit(0), F.col("ko") - 1), F.sequence(F.lit(0), F.col("km") + F.col("ko") - 1)
    task = lambda o, j, right: F.struct(o.cast("int").alias("o"), j.cast("int").alias("j"), F.lit(right).alias("right"))
    as_inside = F.transform(all_o, lambda o: task(o, deal("km"), True))
    as_outside = F.concat(F.transform(all_j, lambda j: task(deal("ko"), j, False)), F.transform(all_o, lambda o: task(o, F.col("km") + deal("ko"), True)))
    return r.select("hub", "nid", "component", F.explode(F.when(inside, as_inside).otherwise(as_outside)).alias("t")).select("hub", "t.*", "nid", "component")


def _compare_blocks(rows: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """Links (a, b) found by the tasks of rows (hub, o, j, right, nid, component, sig, shingles)."""
    need = least_matches(percent / 100, size, miss)

    def side(t: pa.Table, right: bool) -> dict:
        t = t.filter(pa.compute.equal(t["right"], right))
        return {
            "nid": t["nid"].to_numpy(),
            "component": t["component"].to_numpy(),
            "sig": _binary(t["sig"], 2 * size).view("<u2"),
            "set": [np.frombuffer(v.as_buffer(), dtype="<u8") for v in t["shingles"]],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            left, right = side(t, False), side(t, True)
            a, b = _compare(left, right, need, percent) if len(left["nid"]) and len(right["nid"]) else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:  # sorted by task; a task's rows may go on in the next batch
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[lo].tolist())
                if held and key != last:
                    yield flush()
                    held = []
                last = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield flush()

    return rows.repartition("hub", "o", "j").sortWithinPartitions("hub", "o", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, miss: float = 1e-9, block: int = 1024, block_bytes: int = 1 << 25, star: int = 1024, max_broadcast: int = 100_000) -> DataFrame:
    """doc_id, text_key (md5 of the text), n_shingles, component_id and winner for every row of ``docs``.

    ``component_id`` is the smallest id of the row's group. ``winner`` is the struct (doc_id, text_key) of the one
    text of the group that is to stay, smallest first; null for an empty set.
    """
    size = bands * rows
    if size % BATCH:
        raise ValueError(f"bands * rows must be a multiple of {BATCH}")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_key", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    signed = write_table(shingle_signatures(docs, [F.col("doc_id"), F.col("text_key")], width, size), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("node").agg(F.max("sig").alias("sig"), F.max("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_key")).alias("first"))
    classes = write_table(classes.withColumn("nid", F.monotonically_increasing_id()), "classes")  # the ids are fixed by the written table
    band = lambda i: F.xxhash64(i, F.substring("sig", i * 2 * rows + 1, F.lit(2 * rows)))
    banded = classes.select("nid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("key"))
    shared = banded.groupBy("key").agg(F.min("nid").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Spark's estimate leaves out that a class has a row for each band, so it must not choose to broadcast these
    members = write_table(banded.join(shared.hint("merge"), "key").select("pivot", "nid", "key"), "members")
    sets = _member_sets(docs, classes, members, width, max_broadcast)

    pairs = write_table(members.where("nid <> pivot").select(F.col("pivot").alias("a"), F.col("nid").alias("b")).distinct(), "pairs")
    alive = write_table(_prune(_stars(pairs, classes.select("nid", "n_shingles", "sig"), star), size, percent, miss), "survivors")
    links = write_table(_confirm(_stars(alive, sets, star), percent), "linked")
    comp = write_table(connected_components(links), "components")

    open_ = _open_members(members, comp)
    sized = open_.join(classes.select("nid", "n_shingles"), "nid")
    more = _compare_blocks(_blocks(sized, block, block_bytes).join(classes.select("nid", "sig"), "nid").join(sets, "nid").select("hub", "o", "j", "right", "nid", "component", "sig", "shingles"), size, percent, miss)
    more = write_table(more, "more_links")
    done = [members, sets, pairs, alive, links, open_, more, comp]
    if more.limit(1).count():
        comp = write_table(connected_components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")
        done.append(comp)
    out = _labelled(signed, classes, comp)
    discard(*done, classes)
    return out


def _member_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, width: int, max_broadcast: int) -> DataFrame:
    """(nid, shingles) of every class that shares a bucket, from one of its texts."""
    want = classes.join(members.select("nid").distinct(), "nid", "left_semi").select("nid", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    want = write_table(want, "wanted")
    if want.count() <= max_broadcast:  # some 60 bytes a row
        want = F.broadcast(want)
    texts = docs.join(want, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    return write_table(_sets(texts.dropDuplicates(["nid"]), width), "sets")


def _open_members(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Distinct (hub, nid, component) of buckets that lie in two components or more; hub: the pivot's component."""
    rows = members.join(comp.withColumnRenamed("node", "nid"), "nid", "left").select("key", "nid", F.coalesce("component", "nid").alias("component"))
    rows = write_table(rows, "placed_members")
    # the pivot is the bucket's smallest class
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", "nid").alias("hub")).where("lo <> hi").select("key", "hub")
    mixed = write_table(mixed, "mixed_buckets")
    out = write_table(lookup_join(rows, mixed, "key").where("hub IS NOT NULL").select("hub", "nid", "component").distinct(), "open_members")
    discard(rows, mixed)
    return out


def _labelled(signed: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    label = classes.select("node", "nid", "least_id", "first").join(comp.withColumnRenamed("node", "nid"), "nid", "left")
    label = write_table(label.withColumn("component", F.coalesce("component", "nid")), "labels")
    group = label.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min("first").alias("winner"))
    by_set = write_table(label.join(group, "component").select("node", "component_id", "winner"), "groups")
    discard(label)
    return signed.select("doc_id", "text_key", "n_shingles", "node").join(by_set, "node", "left").select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "winner")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group; rows without words stay as they are."""
    groups = near_duplicates(docs, **options)
    stay = groups.where("winner IS NULL OR (doc_id <=> winner.doc_id AND text_key = winner.text_key)")
    stay = write_table(stay.select("doc_id", "text_key", F.col("winner").isNotNull().alias("one")).distinct(), "stay")
    # the row travels as one struct, so that its columns clash with none of ours
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("key"))
    kept = packed.join(stay, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))).select("row", "id", "key", "one")
    once = kept.where("one").dropDuplicates(["id", "key"])  # repeated rows of the text that stays
    return once.unionByName(kept.where("NOT one")).select("row.*")
