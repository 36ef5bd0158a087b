"""SimHash near-duplicates found through an inverted index over byte positions.

Two 64-bit fingerprints that differ in at most `distance` bits differ in at most `distance`
of their eight bytes, so they share at least 8 - distance (position, byte) postings: the count
filter. Postings of single bytes hold 1/256 of all fingerprints each, and tallying them would
emit nearly all pairs; the index therefore posts every combination of `8 - distance` positions
at once, so that a shared posting already is the guaranteed number of matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WIDE_ROWS, Scratch, batches, gathered, texts
from tidemark.llm.graph import components

SEED = 42
#: Postings up to this size are compared inside one task in linear memory; larger ones go through
#: shared neighbours, which never gathers a posting.
LARGE_POSTING = 8192
_PIECE = 1 << 17


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, as an unsigned integer."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*[words[j:] for j in range(shingle)])))
    ones = np.zeros(64, np.int64)
    for s in range(0, len(grams), _PIECE):
        part = grams[s : s + _PIECE]
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in part), np.uint64, len(part))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            fp = np.array([fingerprint(t, shingle) for t in texts(f)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), pa.array(fp)], schema=schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _posting_masks(distance: int) -> list[int]:
    """For every choice of 8 - distance byte positions, the mask that keeps them, as signed 64 bits."""
    masks = []
    for chosen in combinations(range(8), 8 - distance):
        m = sum(0xFF << (8 * p) for p in chosen)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    return masks


def covering_masks() -> list[int]:
    """Masks of 20 triples of byte positions such that any four positions hold one of them.

    Turan's construction: positions in groups of 3, 3 and 2; the triples inside a group, and those
    with two positions in a group and one in the next. Two fingerprints that share four bytes
    then share a posting, at 20 postings each instead of 70, with keys of 24 bits.
    """
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    triples = [t for g in groups for t in combinations(g, 3)]
    triples += [(*two, one) for k, g in enumerate(groups) for two in combinations(g, 2) for one in groups[(k + 1) % 3]]
    masks = [sum(0xFF << (8 * p) for p in t) for t in triples]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _links_small(fp: np.ndarray, group: np.ndarray, distance: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside groups of at most `most` members, by comparing at lags 1, 2, ..."""
    a, b = [], []
    for lag in range(1, most):
        if lag >= len(fp):
            break
        hit = (group[lag:] == group[:-lag]) & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= distance)
        a.append(fp[lag:][hit])
        b.append(fp[:-lag][hit])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _links_large(fp: np.ndarray, distance: int) -> tuple[list, list]:
    """A spanning forest of one posting: every member is linked to the seed it is reached from."""
    a, b = [], []
    rest = fp
    while len(rest):
        seed, rest = rest[0], rest[1:]
        stack = [seed]
        while stack and len(rest):
            near = np.bitwise_count(rest ^ stack.pop()) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                a.extend(found.tolist())
                b.extend([seed] * len(found))
                stack.extend(found)
    return a, b


def links(prints: DataFrame, distance: int, large: int, scratch: Scratch, name: str = "links", masks: list[int] | None = None, rows: int | None = None) -> DataFrame:
    """Edges (a, b) of signed fingerprints that keep every link's endpoints connected.

    `prints` has distinct fp. Inside a posting the members that share the guaranteed bytes are
    verified by their differing bits. Postings of more than `large` members are left to
    `neighbour_links`, which is exact as well. `rows`, if given, is about how many edges there are.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    small = min(8, large)

    def verify(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last posting of a batch, as it may go on in the next
        over: tuple | None = None  # a large posting whose members are marked as they come

        def marked(fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))] * 2, schema=schema)

        def edges(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(fp), bool)
            new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(fp)))
            each = np.repeat(size, size)
            few = (each > 1) & (each <= small)
            a, b = _links_small(fp[few], (np.cumsum(new) - 1)[few], distance, small)
            more_a, more_b = [], []
            for s, n in zip(start[size > small].tolist(), size[size > small].tolist()):
                if n <= large:
                    x, y = _links_large(fp[s : s + n], distance)
                    more_a += x
                    more_b += y
                else:
                    more_a += fp[s : s + n].tolist()  # a loop marks a member of a large posting
                    more_b += fp[s : s + n].tolist()
            a = np.concatenate([a, np.array(more_a, np.uint64)]).view(np.int64)
            b = np.concatenate([b, np.array(more_b, np.uint64)]).view(np.int64)
            if len(a):
                pairs = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)

        for f in frames:
            got = [f.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp")]
            if held:
                got = [np.concatenate(x) for x in zip(held, got)]
            mask, key, fp = got
            last = (mask == mask[-1]) & (key == key[-1])
            if over:  # these come first, as the rows are sorted
                go_on = int(((mask == over[0]) & (key == over[1])).sum())
                if go_on:
                    yield marked(fp[:go_on])
                    mask, key, fp, last = mask[go_on:], key[go_on:], fp[go_on:], last[go_on:]
                if not len(fp):
                    continue
                over = None
            cut = int(np.argmax(last))
            held = [mask[cut:], key[cut:], fp[cut:]]
            if cut:
                yield from edges(mask[:cut], key[:cut], fp[:cut].view(np.uint64))
            if len(held[0]) > large:
                over = (held[0][0], held[1][0])
                yield marked(held[2])
                held = []
        if held:
            yield from edges(held[0], held[1], held[2].view(np.uint64))

    kept = F.array(*[F.lit(m).cast("long") for m in masks or _posting_masks(distance)])
    postings = prints.select("fp", F.posexplode(kept).alias("mask", "m")).select("mask", F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = postings.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key").mapInArrow(verify, "a long, b long")
    return scratch.stage(found.distinct(), name, rows=rows)


def neighbour_links(prints: DataFrame, distance: int) -> DataFrame:
    """Edges through shared neighbours: two fingerprints differ in at most 2r bits if and only if
    some value differs from each in at most r. Each emits its neighbours; those of one value are
    linked to the smallest. Linear in the members, whatever their posting's size.
    """
    if distance % 2:
        raise ValueError("an even distance is needed")
    flips = [0]
    for r in range(1, distance // 2 + 1):
        flips += [sum(1 << i for i in c) for c in combinations(range(64), r)]
    flips = [x - (1 << 64) if x >= 1 << 63 else x for x in flips]
    near = prints.select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("x")) if len(flips) < 100 else prints.select(
        "fp", F.explode(F.from_json(F.lit(str(flips)), "array<long>")).alias("x")
    )
    keyed = near.select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("key"))
    low = keyed.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").drop("top")
    return keyed.join(low, "key").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, large: int = LARGE_POSTING, scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id per row of `docs`.

    component_id is the smallest id reachable over links of at most `distance` differing bits.
    Null and empty texts have fingerprint zero and are linked like any other; a null id belongs
    to its class but never names it, unless the class has no other; equal rows are linked by
    their equal fingerprints; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.stage(fingerprints(docs, id_col, text_col, shingle), "prints")
    n_docs = prints.count()
    distinct = scratch.stage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct", rows=n_docs)
    n = distinct.count()
    found = links(distinct.select("fp"), distance, large, scratch, rows=8 * n)
    crowded = scratch.stage(found.where("a = b").select(F.col("a").alias("fp")), "crowded")
    edges, most = found.where("a != b"), found.count()
    if not crowded.isEmpty():
        edges, most = edges.unionByName(neighbour_links(crowded, distance)), None
    roots = components(edges, scratch, rows=most)
    # A class is named by its smallest id, not by its smallest fingerprint.
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = member.join(member.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return gathered(prints.join(scratch.stage(named, "named", rows=n), "fp").select("doc_id", shown, "component_id"), n_docs)


def minhash_bands(shingles: np.ndarray, rows: int, bands: int) -> list[int]:
    """One signed key per band: a hash of the band's number and of its `rows` least values."""
    least = np.empty(rows * bands, np.uint64)
    for k in range(rows * bands):
        own = shingles * np.uint64(2 * 0x2545F4914F6CDD1D * k + 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
        own ^= own >> np.uint64(29)
        own *= np.uint64(0xBF58476D1CE4E5B9)
        least[k] = (own ^ own >> np.uint64(32)).min()
    keys = [xxhash.xxh3_64_intdigest(least[k * rows : (k + 1) * rows].tobytes(), k) for k in range(bands)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Ascending distinct hashes of the word shingles; of the whole sequence where it is shorter."""
    words = text.lower().split()
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*[words[j:] for j in range(shingle)]))
    return np.unique(np.array([xxhash.xxh3_64_intdigest(g) for g in grams], np.uint64))


def shared_at_most(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, most): how many shingles of each member some other member has too.

    Shingles with one holder only are counted back to it, so common ones, however many members
    have them, are added up before the shuffle and never meet their holders.
    """
    mine = sets.join(members.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), "doc_id", "left_semi")

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for i, b in zip(f.column("doc_id").to_pylist(), f.column("shingles")):
                own = np.frombuffer(b.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i)), pa.array(own)], names=["rep", "shingle"])

    lonely = mine.mapInArrow(each, "rep long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep")).where("n = 1")
    alone = lonely.groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
    sizes = mine.select(F.col("doc_id").alias("rep"), (F.length("shingles") / 8).cast("long").alias("size"))
    return sizes.join(alone, "rep", "left").select("rep", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("most"))


def similar_groups(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, rows: int = 5, miss: float = 1e-4,
    start: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, group): groups of documents linked by a similarity of their word shingles.

    Two documents are a candidate if all `rows` MinHashes of a band are equal; there are as many
    bands as leave a pair at exactly `similarity` unseen with probability `miss`. A candidate is a
    link if the Jaccard similarity of the two texts' `shingle`-word shingles is at least
    `similarity`. A posting (the members of one band key) is tested in rounds: its largest group so
    far is set apart, some of the other members are each tested against all members of other
    groups and then leave it, more of them every round, until one group is left. So every pair of
    a posting is tested or its ends are in one group already. Members that meet most others over
    all their postings are tested first: copies that were all made from one text may be less alike
    among themselves than each is to that text, which links them at once. Pairs that cannot share
    enough shingles, by their sizes and by the shingles that no other member has, are not formed.
    A group is named by its smallest id.
    Texts of equal shingles form one class beforehand. Rows whose id is null are left out.
    `start`, if given, has doc_id and component_id of groups already found; they are taken over, and only
    pairs across them are tested.
    """
    bands = math.ceil(math.log(miss) / math.log(1 - similarity**rows))
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for f in frames:
                for i, t in zip(f.column("doc_id").to_pylist(), texts(f)):
                    own = shingle_set(t, shingle)
                    yield i, xxhash.xxh3_128_digest(own.tobytes()), len(own), minhash_bands(own, rows, bands)

        yield from batches(schema, found())

    mine = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null")
    every = scratch.stage(mine.mapInArrow(run, "doc_id long, class binary, size long, bands array<long>"), "bands")
    n_docs = every.count()
    classes = scratch.stage(every.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")), "classes", rows=n_docs)
    roots = None
    if start is not None:
        known = every.join(start.where("doc_id is not null"), "doc_id").join(classes.select("class", "rep"), "class")
        roots = components(known.select(F.col("rep").alias("a"), F.col("component_id").alias("b")).distinct(), scratch, "start", rows=n_docs)

    def grouped_by(members: DataFrame) -> DataFrame:
        if roots is None:
            return members.withColumn("group", F.col("rep"))
        return members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("group", F.coalesce("root", "rep")).drop("root")

    each = classes.select("rep", "size", F.explode("bands").alias("key"))
    met = each.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("top"), F.count(F.lit(1)).alias("n")).where("low < top").select("key", "n")
    placed = scratch.stage(each.join(met, "key").select("key", "rep", "size", "n"), "placed", rows=4 * n_docs)
    n = placed.count()
    # How many meetings a member has over all its postings: most for the text that others were made from.
    meetings = placed.groupBy("rep").agg(F.sum("n").alias("meetings"))
    # `most` bounds how many shingles a member shares with any other: all, until rarer ones are counted.
    postings = grouped_by(placed.join(meetings, "rep")).select("key", "rep", "group", "meetings", "size", F.col("size").alias("most"))
    postings = scratch.stage(postings, "postings-0", rows=n)

    def shingled(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            sets = [shingle_set(t, shingle).tobytes() for t in texts(f)]
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    asked = postings.select(F.col("rep").alias("doc_id")).distinct()
    read = gathered(mine.join(asked.hint("shuffle_hash"), "doc_id", "left_semi"), n_docs, WIDE_ROWS)
    sets = read.mapInArrow(shingled, "doc_id long, shingles binary").dropDuplicates(["doc_id"])
    sets = scratch.stage(sets, "shingles", rows=n_docs, per=WIDE_ROWS)
    n_sets, n_tried = sets.count(), 0
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verified(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for f in frames:
                for x, y, p, q in zip(*[f.column(c).to_pylist() for c in ("x", "y", "p", "q")]):
                    u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                    shared = len(np.intersect1d(u, v, assume_unique=True))
                    if shared >= similarity * (len(u) + len(v) - shared):
                        yield x, y

        yield from batches(pair, found())

    first, second = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("p")), sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("q"))
    tried = None
    k = 0
    while True:
        counts = postings.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"))
        split = counts.groupBy("key").agg(F.max(F.struct("n", "group")).alias("most"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
        live = scratch.stage(postings.join(split.select("key", F.col("most.group").alias("main")), "key"), f"live-{k}", rows=n)
        n = live.count()
        if not n:
            break
        if k:
            bound = scratch.stage(shared_at_most(live.select("rep").distinct(), sets), f"bound-{k}", rows=n_sets, per=WIDE_ROWS)
            live = live.drop("most").join(bound, "rep").where(F.col("most") >= similarity * F.col("size"))
            live = scratch.stage(live, f"bounded-{k}", rows=n)
            n = live.count()
            if not n:
                break
        once = F.lit(True)
        if k:
            # A pair that shares several live postings is formed in the first of them alone: it stays
            # together there until one of the two is a tester. At most one key per band is gathered.
            live = live.join(live.groupBy("rep").agg(F.collect_set("key").alias("keys")), "rep")
            once = F.col("key") == F.array_min(F.array_intersect("keys", "others"))
        # Testers: at most 4, 32, 256, ... members outside the largest group of each posting.
        mixed = F.xxhash64("rep", F.lit(k))
        drawn = live.where("group != main").groupBy("key", F.pmod(mixed, F.lit(4 * 8 ** min(k, 16))).alias("place"))
        first_of = F.min(F.struct((-F.col("meetings")).alias("m"), mixed.alias("h"), F.col("rep"), F.col("group"), F.col("size"), F.col("most"), *([F.col("keys")] if k else []))).alias("t")
        testers = scratch.stage(drawn.agg(first_of).select("key", F.col("t.rep").alias("tester"), F.col("t.group").alias("own"), F.col("t.size").alias("n"), F.col("t.most").alias("top"), *([F.col("t.keys").alias("others")] if k else [])), f"testers-{k}", rows=n)
        # Similar sets share at least `similarity` / (1 + `similarity`) of the sum of their sizes.
        enough = F.least("most", "top") >= F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("n")) - 1e-6
        met = live.join(testers, "key").where((F.col("group") != F.col("own")) & enough & once)
        pairs = met.select(F.greatest("rep", "tester").alias("x"), F.least("rep", "tester").alias("y")).distinct()
        pairs = scratch.stage(pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti"), f"pairs-{k}", rows=8 * n + n_tried)
        n_pairs = pairs.count()
        n_tried += n_pairs
        tried = pairs if tried is None else tried.unionByName(pairs)
        compared = gathered(pairs.join(first, "x").join(second, "y"), max(n_pairs, n_sets), WIDE_ROWS)  # all sets are read, however few pairs there are
        linked = scratch.stage(compared.mapInArrow(verified, "a long, b long"), f"linked-{k}")
        # Links are drawn between groups, so a round's components meet new links only.
        ends = linked
        if roots is not None:
            for c in ("a", "b"):
                ends = ends.join(roots.select(F.col("node").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        fresh = components(ends.select("a", "b"), scratch, f"groups-{k}", rows=n_pairs)
        if roots is not None:
            moved = roots.join(fresh.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
            fresh = fresh.unionByName(moved.select("node", F.coalesce("to", "root").alias("root")))
        roots = scratch.stage(fresh, f"roots-{k}", rows=n_docs)
        rest = live.join(testers.select("key", F.col("tester").alias("rep")), ["key", "rep"], "left_anti").select("key", "rep", "meetings", "size", "most")
        rest = grouped_by(rest).select("key", "rep", "group", "meetings", "size", "most")
        k += 1
        postings = scratch.stage(rest, f"postings-{k}", rows=n + n_docs)
        scratch.drop(f"postings-{k - 1}", f"live-{k - 1}", f"testers-{k - 1}")
    return every.select("doc_id", "class").join(grouped_by(classes.select("class", "rep")), "class").select("doc_id", "group")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that name their group: one row of each group stays.

    Groups are the classes of `near_duplicates`, by fingerprints and their index; `similar_groups` then
    tests exactly what they leave apart, as blocks added or cut can change more bits than the distance.
    Rows that repeat in every column count as one; rows whose id is null stay, as no id tells them apart.
    Only the kept ids stay in the shared folder; the index, bands, classes, shingles and pairs are freed
    before the caller goes on.
    """
    scratch, result = Scratch(docs.sparkSession, "similar"), Scratch(docs.sparkSession, "kept")
    index = Scratch(docs.sparkSession, "simhash")
    prints = scratch.stage(near_duplicates(docs, id_col, text_col, scratch=index).select("doc_id", "component_id"), "prints")
    index.clear()
    groups = similar_groups(docs, scratch, id_col, text_col, start=prints, **how)
    kept = groups.where(F.col("doc_id") == F.col("group")).select(F.col("doc_id").alias("_kept")).distinct()
    n_docs = prints.count()
    kept = result.stage(kept, "ids", rows=n_docs)
    scratch.clear()
    named = docs.join(kept.hint("shuffle_hash"), docs[id_col] == kept["_kept"], "left_semi").distinct()
    named = gathered(named, n_docs, WIDE_ROWS)
    return named.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
