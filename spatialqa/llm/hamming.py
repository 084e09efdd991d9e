"""MinHash near-dedup by a multi-index Hamming join.

A signature has ``CHUNKS`` chunks of ``SYMBOLS`` minima, ``BITS`` bits of each, one long a
chunk. Two signatures that differ in at most ``DISTANCE`` symbols differ, by the pigeonhole
principle, in at most one symbol of some chunk; so each chunk gives one key for each symbol
left out, and all such pairs share a key. Pairs come from the join on keys alone, whose
condition is the distance of the signatures, and links are confirmed on the full sets.

Near copies would give a key all their pairs. Each document is therefore first compared, in a
few rounds, with the nearest of those that come first or last in its keys; if they are linked, that one is its centre, at a known
Jaccard distance. Only centres of parts that aren't joined yet meet over the keys. The
Jaccard distance is a metric, so members of two centres can be linked only where the distance
of the centres is at most the threshold's and theirs together; just these meet as well.
Before that, the shingles that no other part has are counted: no link across parts can use
them, so texts around a common passage, alike but not enough, drop out without a pair.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb
from typing import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from spatialqa.llm.common import discard, fields, flat_map, materialize, squeezed, text_of
from spatialqa.llm.graph import components
from spatialqa.session import packed_rows, unfolded

SHINGLE, PERCENT = 5, 85
SYMBOLS, BITS = 5, 12
#: The share of pairs at the least similarity that may lie beyond the guaranteed distance.
MISSED = 1e-6


def distance(chunks: int) -> int:
    """One error in each chunk is allowed, so this distance is guaranteed."""
    return 2 * chunks - 1


def chunks_for(percent: int) -> int:
    """The least number of chunks with which no more than ``MISSED`` of the pairs at this similarity are missed.

    Each symbol of such a pair differs with probability 1 - percent / 100: 13 chunks for 85, 23 for 80.
    """
    p = 1 - percent / 100
    for chunks in range(1, 64):
        n = chunks * SYMBOLS
        if sum(comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(distance(chunks) + 1, n + 1)) <= MISSED:
            return chunks
    raise ValueError(f"signatures cannot find pairs at a similarity of {percent} percent")


CHUNKS = chunks_for(PERCENT)
DISTANCE = distance(CHUNKS)
#: The highest bit of each symbol, and the others.
HIGH = sum(1 << (BITS * i + BITS - 1) for i in range(SYMBOLS))
REST = (1 << BITS * SYMBOLS) - 1 - HIGH
#: Bits of a key that tell its chunk and symbol.
SLOT = 511
#: Rounds in which documents look for a centre.
ROUNDS = 4
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def permutations(chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts, one of each for every symbol."""
    factors = np.random.default_rng(20240229).integers(1, 1 << 63, chunks * SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, np.random.default_rng(4051).integers(0, 1 << 63, chunks * SYMBOLS, np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the ``SHINGLE``-word sequences of the lower-cased text.

    Fewer words: their whole sequence as one shingle; no words: none.
    """
    import xxhash
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00short " + b" ".join(words))], np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ h[i:i + len(out)]) * MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(found: np.ndarray, chunks: int = CHUNKS) -> list[int]:
    factors, shifts = permutations(chunks)
    least = np.full(chunks * SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 2048):
        part = found[start:start + 2048]
        least = np.minimum(least, (part[None, :] * factors[:, None] + shifts[:, None]).min(axis=1))
    least ^= least >> np.uint64(31)
    symbols = ((least * MIX) >> np.uint64(64 - BITS)).reshape(chunks, SYMBOLS)
    places = np.uint64(BITS) * np.arange(SYMBOLS, dtype=np.uint64)
    return (symbols << places).sum(axis=1).astype(np.int64).tolist()


def signatures(docs: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """doc_id, set size, a 128-bit print of the set, its signature."""
    def start() -> Callable[..., Iterator[tuple]]:
        def one(doc: int | None, text: str) -> Iterator[tuple]:
            found = shingles(text.encode("utf-8", "replace"))
            if len(found):
                yield doc, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), signature(found, chunks)
            else:
                yield doc, 0, None, None
        return one

    return flat_map(docs, start, fields("doc_id long,n long,print binary,sig longs"))


def keys(sig: Column, chunks: int = CHUNKS) -> Column:
    """One key for each chunk and each of its symbols left out; its lowest bits tell which."""
    out = []
    for c in range(chunks):
        for s in range(SYMBOLS):
            keep = ((1 << BITS * SYMBOLS) - 1) ^ (((1 << BITS) - 1) << BITS * s)
            slot = F.lit(c * SYMBOLS + s)
            out.append(F.xxhash64(slot, sig[c].bitwiseAND(F.lit(keep))).bitwiseAND(F.lit(~SLOT)).bitwiseOR(slot.cast("long")))
    return F.array(*out)


def errors(chunks: int) -> list[Column]:
    """For each chunk the symbols in which the signatures of the rows ``x`` and ``y`` of a join differ."""
    out = []
    for c in range(chunks):
        d = F.col(f"x.s{c}").bitwiseXOR(F.col(f"y.s{c}"))
        # A symbol's highest bit is set, or gets a carry from the others, if any of its bits is.
        out.append(F.bit_count((d.bitwiseAND(F.lit(REST)) + F.lit(REST)).bitwiseOR(d).bitwiseAND(F.lit(HIGH))))
    return out


def symbols(chunks: int) -> list[Column]:
    return [F.col("sig")[c].alias(f"s{c}") for c in range(chunks)]


def first_shared(chunks: int) -> tuple[Column, Column]:
    """Whether the key of a join is the first one that the signatures of its rows ``x`` and ``y`` share, and whether they share none."""
    # The first chunk with at most one error; all keys of a chunk are shared if it has none.
    first = F.coalesce(*[F.when(e <= 1, 2 * c + (e == 0).cast("int")) for c, e in enumerate(errors(chunks))])
    slot = F.col("x.key").bitwiseAND(F.lit(SLOT))
    chunk = F.floor(slot / SYMBOLS)
    return F.coalesce((first == 2 * chunk) | (first == 2 * chunk + 1) & (slot % SYMBOLS == 0), F.lit(False)), first.isNull()


@lru_cache
def allowed(chunks: int) -> tuple[int, ...]:
    """For Jaccard distances of 0, 1, ... 100 percent the symbols that differ in no more than ``MISSED`` of the pairs beyond."""
    n, out = chunks * SYMBOLS, []
    for percent in range(101):
        p, d, tail = percent / 100, n, 0.0
        while d > 0 and (tail := tail + comb(n, d) * p ** d * (1 - p) ** (n - d)) <= MISSED:
            d -= 1
        out.append(d)
    return tuple(out)


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) with ``far``, the Jaccard distance of their sets, and whether they are ``linked``."""
    left, right = sets.select(F.col("id").alias("a"), F.col("found").alias("x")), sets.select(F.col("id").alias("b"), F.col("found").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b").select(*pairs.columns, shared.alias("_shared"), (F.size("x") + F.size("y")).alias("_all"))
    union = F.col("_all") - F.col("_shared")
    return both.select(*pairs.columns, (1 - F.col("_shared") / union).alias("far"), (100 * F.col("_shared") >= percent * union).alias("linked"))


def nearest(candidates: DataFrame, reps: DataFrame, percent: int, chunks: int) -> DataFrame:
    """For each document b the nearest by signature (a) of its ``candidates`` (rep, other) within the distance; well within the threshold, the smallest."""
    signed = packed_rows(reps).select("rep", *symbols(chunks))
    far = sum(errors(chunks), F.lit(0))
    pairs = candidates.join(signed, "rep").alias("x").join(signed.alias("y"), (F.col("x.other") == F.col("y.rep")) & (far <= distance(chunks)))
    well = chunks * SYMBOLS * (100 - percent) // 200
    best = pairs.groupBy(F.col("x.rep").alias("b")).agg(F.min(F.struct(F.greatest(far, F.lit(well)).alias("far"), F.col("x.other").alias("a"))).alias("m"))
    return best.select("m.a", "b")


def open_members(members: DataFrame) -> DataFrame:
    """Members of keys that two parts share, each with ``other``: the smallest or the largest member of its key, whichever is of another part; null for neither."""
    one = F.struct("rep", "part")
    ends = (members.groupBy("key").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.min("part").alias("p"), F.max("part").alias("q"))
            .where("p < q").select("key", "lo", "hi"))
    other = F.when(F.col("lo.part") != F.col("part"), F.col("lo.rep")).when(F.col("hi.part") != F.col("part"), F.col("hi.rep"))
    return packed_rows(members).join(ends, "key").select("key", "rep", "part", other.alias("other"))


def shareable(open_: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``open_`` (key, rep, part, ...) that a link to another part can still reach, with the sizes ``lo`` to ``hi`` of their sets and ``most``, the largest set they can link with.

    Shingles that no other part has are in no intersection with one. If m others are left of n, a
    link with a set of n' needs 100 * m >= percent * (n + n' - m), and m of at least ``percent`` of n.
    """
    ends = open_.select(F.col("rep").alias("id"), "part").distinct()
    each = unfolded(sets.join(ends, "id").select("id", "part", F.explode("found").alias("shingle")))
    several = each.groupBy("shingle").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("shingle")
    left = each.join(several, "shingle").groupBy(F.col("id").alias("rep")).agg(F.count("*").alias("m"))
    sizes = packed_rows(reps).groupBy("rep").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    most = F.floor(F.col("m") * (100 + percent) / percent + 1e-6) - F.col("lo")
    return packed_rows(open_).join(left.join(sizes, "rep").where(f"100 * m >= {percent} * lo").select("rep", "lo", "hi", most.alias("most")), "rep")


def fitting(percent: int) -> Column:
    """Whether sets of the rows ``x`` and ``y`` of a join can be linked, by their sizes and by what they have in common with other parts."""
    return ((100 * F.col("x.hi") >= percent * F.col("y.lo")) & (100 * F.col("y.hi") >= percent * F.col("x.lo"))
            & (F.col("x.lo") <= F.col("y.most")) & (F.col("y.lo") <= F.col("x.most")))


def centre_tips(open_: DataFrame, placed: DataFrame, reps: DataFrame, chunks: int) -> DataFrame:
    """(key, centre, part, lo, hi, most, radius, s0, s1, ...) of the centres in ``open_``: the keys of their own signature, then those that only members have.

    Bounds are those of all open members at a centre's own keys, and of the members that have the key elsewhere.
    """
    bounds = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("most").alias("most")]
    radius = packed_rows(placed).groupBy("centre").agg(F.max("away").alias("radius"))
    signed = packed_rows(reps).select(F.col("rep").alias("centre"), "sig")
    columns = ["key", "centre", "part", "lo", "hi", "most", "radius", *symbols(chunks)]
    own = (open_.groupBy("centre", "part").agg(*bounds).join(radius, "centre").join(signed, "centre")
           .withColumn("key", F.explode(keys(F.col("sig"), chunks))).select(*columns))
    slot = F.col("key").bitwiseAND(F.lit(SLOT)).cast("int")
    kept = F.get(F.array(*[F.lit(((1 << BITS * SYMBOLS) - 1) ^ (((1 << BITS) - 1) << BITS * i)) for i in range(SYMBOLS)]), slot % SYMBOLS)
    there = F.xxhash64(slot, F.get("sig", F.floor(slot / SYMBOLS).cast("int")).bitwiseAND(kept)).bitwiseAND(F.lit(~SLOT)).bitwiseOR(slot.cast("long"))
    theirs = (open_.groupBy("key", "centre", "part").agg(*bounds).join(radius, "centre").join(signed, "centre")
              .where(F.col("key") != there).select(*columns))
    return own.unionByName(theirs)


def met_centres(tips: DataFrame, percent: int, chunks: int) -> DataFrame:
    """Pairs a < b of centres of two parts with a key in common whose signatures are near enough, with their radii.

    ``tips`` comes from ``centre_tips``. Centres that share keys of their own meet by the first of them alone: a row for each
    key they or their members share would be dozens a pair. Those that share none meet by the keys of their members.
    """
    least = (100 - percent) / 100
    reach = F.least(F.ceil(100 * (least + F.col("x.radius") + F.col("y.radius")) - 1e-6), F.lit(100)).cast("int")
    near = sum(errors(chunks), F.lit(0)) <= F.get(F.array(*map(F.lit, allowed(chunks))), reach)
    once, apart = first_shared(chunks)
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.centre") < F.col("y.centre")) & (F.col("x.part") != F.col("y.part")) & fitting(percent) & near & (once | apart)
    tips = packed_rows(tips)
    pairs = tips.alias("x").join(tips.alias("y"), on)
    return pairs.groupBy(F.col("x.centre").alias("a"), F.col("y.centre").alias("b")).agg(F.max("x.radius").alias("ra"), F.max("y.radius").alias("rb"))


def met_members(open_: DataFrame, rest: DataFrame, reps: DataFrame, percent: int, chunks: int) -> DataFrame:
    """Pairs of members of the centres (a < b, far) in ``rest`` that may be linked, each by the first of the keys it shares; ``open_`` has (key, rep, part, centre, away, lo, hi, most).

    Members meet by key alone and look up their centres as a pair: one row for each member, key and pair
    of its centre would grow with the square of a crowd of centres before anything is compared.
    """
    met = rest.select(F.col("a").alias("centre")).union(rest.select(F.col("b").alias("centre"))).distinct()
    some = packed_rows(open_.join(met, "centre", "left_semi").join(packed_rows(reps).select("rep", *symbols(chunks)), "rep"))
    least = (100 - percent) / 100
    once, _ = first_shared(chunks)
    on = ((F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.part") != F.col("y.part")) & (F.col("x.centre") != F.col("y.centre"))
          & fitting(percent) & (sum(errors(chunks), F.lit(0)) <= distance(chunks)) & once)
    pairs = some.alias("x").join(some.alias("y"), on).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.least("x.centre", "y.centre").alias("ca"), F.greatest("x.centre", "y.centre").alias("cb"),
        (F.col("x.away") + F.col("y.away")).alias("away"))
    bounds = packed_rows(rest).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "far")
    return pairs.join(bounds, ["ca", "cb"]).where(F.col("away") + least >= F.col("far") - 1e-9).select("a", "b").distinct()


def joining_links(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, chunks: int) -> DataFrame:
    """Links (a, b), enough of them to give all components; ``members`` has (key, rep, other).

    In ``ROUNDS`` rounds, which only save work, each document is compared with the nearest of
    those that come first or last in its keys and are of another part; keys within one part
    drop out. A document's first link is to its centre. What is left meets by centres.
    """
    tried, now, held = None, members, members
    for turn in range(ROUNDS):
        if turn:
            held = materialize(open_members(now))
            discard(now)
        wanted = held.where("other is not null").select("rep", "other").distinct()
        if turn:
            wanted = packed_rows(wanted).join(tried.select(F.col("b").alias("rep"), F.col("a").alias("other")), ["rep", "other"], "left_anti")
        fresh = materialize(compared(nearest(wanted, reps, percent, chunks), sets, percent).select("a", "b", "far", "linked", F.lit(turn).alias("turn")))
        found = not fresh.where("linked").isEmpty()
        tried = tried.unionByName(fresh) if turn else fresh
        links = tried.where("linked")
        parts = materialize(components(links).select(F.col("id").alias("rep"), F.col("component").alias("of")))
        now = materialize(packed_rows(held).select("key", "rep").join(parts, "rep", "left").select("key", "rep", F.coalesce("of", "rep").alias("part")))
        discard(held)
        if not found:
            break
    # A document of several texts has no one place among the others: it is its own centre, and nobody else's.
    several = reps.groupBy("rep").count().where("count > 1")
    plain = links.join(several.select(F.col("rep").alias("a")), "a", "left_anti").join(several.select(F.col("rep").alias("b")), "b", "left_anti")
    star = plain.groupBy(F.col("b").alias("rep")).agg(F.min(F.struct("turn", "a", "far")).alias("s")).select("rep", F.col("s.a").alias("centre"), F.col("s.far").alias("away"))
    placed = (packed_rows(reps).select("rep").join(star, "rep", "left")
              .select("rep", F.coalesce("centre", "rep").alias("centre"), F.coalesce("away", F.lit(0.0)).alias("away")))
    placed = materialize(placed)
    ends = materialize(open_members(now).select("key", "rep", "part"))
    discard(now)
    open_ = materialize(shareable(ends, reps, sets, percent).join(packed_rows(placed), "rep"))
    discard(ends)
    tips = materialize(centre_tips(open_, placed, reps, chunks))
    met = materialize(compared(met_centres(tips, percent, chunks), sets, percent))
    discard(tips)
    least = (100 - percent) / 100
    rest = met.where(~F.col("linked") & (F.col("ra") + F.col("rb") > 0) & (F.col("far") - 1e-9 <= least + F.col("ra") + F.col("rb")))
    more = materialize(compared(met_members(open_, rest.select("a", "b", "far"), reps, percent, chunks), sets, percent).where("linked").select("a", "b"))
    all_ = materialize(links.select("a", "b").unionByName(met.where("linked").select("a", "b")).unionByName(more))
    discard(placed, open_, met, more)
    return all_


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``; links are pairs with a similarity of ``percent`` or more.

    A null or empty text has no shingles and is linked with nothing; so is a row with a null
    id, which is kept. Rows that share an id are one document that has each of its texts.
    Equal sets collapse to their smallest id before any pair is made. Only doc_id and text
    are read.
    """
    chunks = chunks_for(percent)
    docs = docs.select("doc_id", text_of().alias("text"))
    signed = materialize(signatures(docs, chunks))
    full = signed.where("n > 0 and doc_id is not null")
    reps = materialize(full.groupBy("print").agg(F.min(F.struct("doc_id", "n", "sig")).alias("r"))
                       .select("print", F.col("r.doc_id").alias("rep"), "r.n", "r.sig"))
    keyed = unfolded(reps.select("rep", F.explode(keys(F.col("sig"), chunks)).alias("key")))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    other = F.when(F.col("rep") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    members = materialize(keyed.join(shared, "key").select("key", "rep", other.alias("other")))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()

    def start() -> Callable[..., Iterator[tuple]]:
        import zstandard
        press = zstandard.ZstdDecompressor()
        return lambda doc, z: [(doc, shingles(press.decompress(z)).view(np.int64))]

    sets = materialize(flat_map(squeezed(docs).join(packed_rows(wanted), "doc_id").select("doc_id", "z"), start, fields("id long,found longs")))
    links = joining_links(members, reps, sets, percent, chunks)
    discard(sets)
    found = components(links)
    classes = packed_rows(reps).join(found, reps.rep == found.id, "left").select(F.col("print").alias("p"), F.coalesce("component", "rep").alias("c"))
    out = packed_rows(signed).join(classes, signed.print == classes.p, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
