"""Parity-sketch join: all near-duplicate links between documents, exactly, without all pairs.

A document is the set of its distinct 5-word shingles (as 64-bit hashes). Texts with
equal sets form one class; links are searched between classes only.

1. *Sketch.* The hash range is cut into P parts and each part keeps the XOR of its
   shingles' hashes: the fingerprint of a parity sketch in which each shingle flips one
   bit of its part. One differing shingle changes at most one part, so the number of
   parts that differ is a lower bound of the symmetric difference.
2. *Pigeonhole per size band.* Sets of a and b shingles with Jaccard >= t differ in at
   most D = (a + b)(1 - t)/(1 + t) shingles. With P > D parts, at least P - D parts are
   equal, so an equality join on (band, part, XOR) finds every link. P follows from the
   band of the smaller set; the larger one also emits for the band below it.
   P has spare parts, so a link has more equal parts than spare ones, and a set may leave
   out as many parts as are spare: empty ones, and those that more than ``HOT_CLASSES``
   classes share, as a passage makes them that many documents quote. A part is common for
   both sides or for neither, so a link keeps an equal part unless both its sets have more
   empty and common parts than spare ones; such sets (copies of one text, above all) leave
   nothing out.
3. *Filter and verify.* Candidates must pass a compact parity sketch of about two bits per
   shingle, each shingle flipping a single bit (Hamming distance <= D), and then an exact
   intersection of the two sets. Only sets of pairs that pass are ever moved.

Candidates of a part are taken as stars around the part's smallest class, its lead, rather
than as pairs. What stars leave open is settled by a last round over parts whose classes
are not in one component yet: their members' compact sketches are compared in blocks of
bounded size, spread over tasks, and only pairs that pass the sketch leave a block. Parts
with one lead are one group, which a class enters once and not once for each part; a lead
whose parts have little in common is taken part by part instead. Of a group's largest
component the pairs are settled, so its classes meet those of the others only. So no link
between components is lost, no part's pairs are emitted, and a component that holds most
of a group costs in proportion to its size.

Parts that a sample of the documents shows to be very common are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, contracted
from .store import discard, materialize, release_shuffles
from .wordscan import U64, mix, shingle_sets, slices

#: Each band holds sizes from its base to BAND_RATIO times it.
BAND_RATIO = 1.7
#: Parity sketches have the next power of two of twice their sets' sizes in bits, within these bounds.
LEAST_BITS, MOST_BITS = 256, 1 << 20
#: Classes that share a part, beyond which sets that can spare the part leave it out.
HOT_CLASSES = 64
#: Rows of a block of the last round; a task holds two.
BLOCK_ROWS = 2048
#: Names of classes that a partition remembers.
SEEN_CLASSES = 1 << 20
#: One document in so many is looked at for parts that are very common.
SAMPLE_ONE_IN = 64
#: A part is very common if so many of the sampled documents have it, and one in so many of them.
BUSY_LEAST, BUSY_ONE_IN = 16, 2000
#: Tasks that the rows of a very common part are dealt to.
SALTS = 64
#: Very common parts up to which they are broadcast (8 bytes each).
MOST_BROADCAST = 500_000
#: Names of sets are made anew, from another seed, if two different sets share one.
SEEDS = 8


def band_bases(largest: int) -> list[int]:
    bases = [1]
    while bases[-1] <= largest:
        bases.append(max(bases[-1] + 1, int(bases[-1] * BAND_RATIO)))
    return bases


class Bands:
    """Size bands and their numbers of parts, for one threshold (in percent)."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bases = band_bases(1 << 40)

    def most_different(self, both: int) -> int:
        """Largest symmetric difference of sets with ``both`` shingles together that link."""
        return both * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.bases, n, side="right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """Parts of the pairs whose smaller set is in ``band``, and the spare ones among them."""
        smaller = self.bases[band + 1] - 1
        least = self.most_different(smaller + smaller * 100 // self.percent) + 1
        spare = (least * 15 + 99) // 100 if least > 8 else 0
        return least + spare, spare

    def emitted(self, n: int) -> list[int]:
        """Bands for which a set of n shingles emits: its own, and those whose sets may be smaller partners."""
        own = self.of(n)
        out, band = [own], own - 1
        while band >= 0 and (self.bases[band + 1] - 1) * 100 >= n * self.percent:
            out.append(band)
            band -= 1
        return out


def set_class(s: np.ndarray, seed: int = 0) -> int:
    """64-bit name of a set: equal sets have equal names."""
    if not len(s):
        return 0
    parity = np.bitwise_xor.reduce(mix(s ^ U64(0xA5A5A5A5A5A5A5A5 + 2 * seed)), keepdims=True)
    total = s.sum(dtype=np.uint64, keepdims=True) * U64(0x9E3779B97F4A7C15)
    return int(mix(parity + total + U64(len(s))).view(np.int64)[0])


def set_check(s: np.ndarray) -> int:
    """A second 64-bit name, of other sums: sets with one name are told apart by it."""
    x = mix(s * U64(0xC2B2AE3D27D4EB4F) + U64(1))
    return int(mix(x.sum(dtype=np.uint64, keepdims=True) ^ np.bitwise_xor.reduce(x * (x >> U64(7)), keepdims=True)).view(np.int64)[0]) if len(s) else 0


def part_keys(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of a sorted set, one for each part that it must be found by, and for each its band and what the band lets it leave out.

    The latter is one number: the band times 2**32, plus 1 + the parts that can be spared
    besides empty ones; plus 0 if empty parts alone are too many, and so emitted too.
    """
    keys, notes = [], []
    for band in bands.emitted(len(s)):
        n_parts, spare = bands.parts(band)
        part = ((s >> U64(32)) * U64(n_parts)) >> U64(32)
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        word, at = np.bitwise_xor.reduceat(s, begin), part[begin]
        left = spare - (n_parts - len(begin))
        if left < 0:
            empty = np.setdiff1d(np.arange(n_parts, dtype=np.uint64), at)
            word, at = np.concatenate((word, np.zeros(len(empty), dtype=np.uint64))), np.concatenate((at, empty))
        keys.append(mix(word ^ mix(at + U64(band << 40))))
        notes.append(np.full(len(word), (band << 32) + max(left + 1, 0), dtype=np.int64))
    return np.concatenate(keys), np.concatenate(notes)


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Parities as longs: shingle h flips bit h mod the number of bits, so that half a sketch folded onto the other is the smaller sketch."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(2 * len(s) - 1, 0).bit_length()))
    odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _list_array(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate([v.view(np.int64) for v in values]) if values else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _signatures(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, 1):
                sizes, names, checks, sketches = [], [], [], []
                for s in shingle_sets(texts, words):
                    sizes.append(len(s))
                    names.append(set_class(s, seed))
                    checks.append(set_check(s))
                    sketches.append(parity_sketch(s) if len(s) else s)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *(pa.array(x, pa.int64()) for x in (sizes, names, checks)), _list_array(sketches, pa.int64())], ["doc_id", "text_hash", "n_shingles", "cls", "check", "sketch"])

    return run


def _keys(words: int, percent: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()

        def result(keys: list[np.ndarray], names: list[np.ndarray], notes: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(notes))], ["key", "cls", "note"])

        for batch in batches:
            for _, texts in slices(batch, 0):
                keys, names, notes, held = [], [], [], 0
                for s in shingle_sets(texts, words):
                    if not len(s) or (name := set_class(s, seed)) in seen:
                        continue
                    if len(seen) < SEEN_CLASSES:
                        seen.add(name)
                    own, note = part_keys(s, bands)
                    keys.append(own)
                    notes.append(note)
                    names.append(np.full(len(own), name, dtype=np.int64))
                    held += len(own)
                    if held > 1 << 17:
                        yield result(keys, names, notes)
                        keys, names, notes, held = [], [], [], 0
                if keys:
                    yield result(keys, names, notes)

    return run


def _sets(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part, texts in slices(batch, 0):
                wanted, rows = part.column(1).to_pylist(), []
                for k, s in enumerate(shingle_sets(texts, words)):
                    # another text under a repeated id is of another class; repeated rows are needed once
                    if wanted[k] not in seen and set_class(s, seed) == wanted[k]:
                        seen.add(wanted[k])
                        rows.append((wanted[k], s))
                yield pa.RecordBatch.from_arrays([pa.array([name for name, _ in rows], pa.int64()), _list_array([s for _, s in rows], pa.int64())], ["cls", "shingles"])

    return run


def _busy(doc: DataFrame, words: int, percent: int) -> DataFrame:
    """``key`` of the parts that are very common, as far as a sample shows it; which they are decides where rows go, never what is found."""
    sample = doc.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0).select("text")
    counts = materialize(sample.mapInArrow(_keys(words, percent, 0), "key long, cls long, note long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= BUSY_LEAST), "busy")
    return counts.filter(F.col("n") * BUSY_ONE_IN >= sample.count()).select("key", F.lit(True).alias("busy"))


def _shared(keys: DataFrame, busy: DataFrame) -> DataFrame:
    """``(key, cls, note, hot)`` of the parts that several classes share, each class once. Very common ones may hold a single class."""
    keys = keys.join(F.broadcast(busy) if busy.count() <= MOST_BROADCAST else busy, "key", "left")
    keys = keys.withColumn("salt", F.when(F.col("busy"), F.pmod(F.xxhash64("cls"), F.lit(SALTS))).otherwise(0).cast("int"))
    of_key = Window.partitionBy("key", "salt")
    before = F.lag("cls").over(of_key.orderBy("cls"))
    once = keys.withColumn("before", before).filter("before is null or before <> cls")
    return once.withColumn("n", F.count("*").over(of_key)).filter("n > 1 or busy").select("key", "cls", "note", (F.col("busy").isNotNull() | (F.col("n") > HOT_CLASSES)).alias("hot"))


def _stars(shared: DataFrame) -> DataFrame:
    """``(key, lead, cls)``: each part's classes other than its smallest, common parts left out where they can be."""
    own = F.col("note").bitwiseAND(F.lit((1 << 32) - 1))
    heavy = shared.filter("hot").groupBy("cls", "note").agg(F.count("*").alias("n")).filter(F.col("n") >= own).select("cls", "note")
    kept = shared.filter("not hot").unionByName(shared.filter("hot").join(heavy, ["cls", "note"], "left_semi").select(*shared.columns)).select("key", "cls")
    leads = kept.groupBy("key").agg(F.min("cls").alias("lead"))
    return kept.join(leads, "key").filter("cls <> lead").select("key", "lead", "cls")


def _end(sets: DataFrame, x: str, *columns: str) -> DataFrame:
    """Columns of ``sets`` for end ``x`` of a pair."""
    return sets.select(F.col("cls").alias(x), *(F.col(c).alias(c + x) for c in columns))


def _possible(percent: int) -> Column:
    """By sizes and by the sketches' Hamming distance, a pair may link.

    Sizes that may link differ by a factor below two, so one sketch is folded once at most.
    """
    a, b = F.col("sketcha"), F.col("sketchb")
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    folded = lambda x: xor(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")))
    difference = F.when(F.size(a) > F.size(b), xor(folded(a), b)).when(F.size(a) < F.size(b), xor(a, folded(b))).otherwise(xor(a, b))
    apart = F.aggregate(difference, F.lit(0), lambda n, x: n + F.bit_count(x))
    sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return sized & F.when(sized, apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


def _links(percent: int) -> Column:
    """By its intersection, a pair links."""
    both = F.size(F.array_intersect("shinglesa", "shinglesb")).cast("long")
    return both * 100 >= (F.col("na") + F.col("nb") - both) * percent


def _passing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that the compact sketches let pass, with their sizes."""
    near = pairs.join(_end(classes, "a", "n", "sketch"), "a").join(_end(classes, "b", "n", "sketch"), "b")
    return near.filter(_possible(percent)).select("a", "b", "na", "nb")


def _verified(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``near(a, b, na, nb)`` that link."""
    return near.join(_end(sets, "b", "shingles"), "b").join(_end(sets, "a", "shingles"), "a").filter(_links(percent)).select("a", "b")


def _folded(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def block_pairs(names: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int, int, int]]:
    """(a, b, na, nb) of one block's pairs that may link: of different roots, and of different sides if there are two."""
    out: list[tuple[int, int, int, int]] = []
    both = len(np.unique(sides)) > 1
    order = np.lexsort((names, sizes))
    names, roots, sizes, sides = names[order], roots[order], sizes[order], sides[order]
    widths = np.array([len(sketches[k]) for k in order])
    # unsigned: of a negative number NumPy counts the bits of its absolute value
    by_width = {w: np.stack([sketches[k] for k, of in zip(order, widths, strict=True) if of == w]).view(np.uint64) for w in np.unique(widths).tolist()}
    first = {w: int(np.searchsorted(widths, w)) for w in by_width}  # widths never fall as sizes grow
    for w, own in by_width.items():
        wider = [(first[w], own, True)]
        if 2 * w in by_width:
            wider.append((first[2 * w], _folded(by_width[2 * w]), False))
        for k in range(len(own)):
            i = first[w] + k
            for base, others, same in wider:
                start = k + 1 if same else 0
                stop = int(np.searchsorted(sizes, sizes[i] * 100 // percent, side="right")) - base
                stop = min(stop, len(others))
                if start >= stop:
                    continue
                rest = slice(base + start, base + stop)
                open_ = (roots[rest] != roots[i]) & ((sides[rest] != sides[i]) | (not both))
                if not open_.any():
                    continue
                apart = np.bitwise_count(others[start:stop][open_] ^ own[k]).sum(axis=1, dtype=np.int64)
                at = np.flatnonzero(open_)[apart * (100 + percent) <= (sizes[rest][open_] + sizes[i]) * (100 - percent)] + base + start
                for j in at.tolist():
                    low, high = (i, j) if names[i] < names[j] else (j, i)
                    out.append((int(names[low]), int(names[high]), int(sizes[low]), int(sizes[high])))
    return out


def _blocks(percent: int):
    """Over rows sorted by (of, i, j): each such group is a block; it may go over the end of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        known: set[tuple[int, int]] = set()

        def emitted(table: pa.Table) -> list[tuple[int, int, int, int]]:
            column = lambda c: table.column(c).to_numpy()
            of, i, j = column("of"), column("i"), column("j")
            names, roots, sizes, sides = column("cls"), column("root"), column("n"), column("side")
            lists = table.column("sketch").combine_chunks()
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            out = []
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                if end - begin > 1:
                    own = [flat[offsets[k] : offsets[k + 1]] for k in range(begin, end)]
                    found = block_pairs(names[begin:end], roots[begin:end], sizes[begin:end], own, sides[begin:end], percent)
                    out += [x for x in found if x[:2] not in known]
                    if len(known) < SEEN_CLASSES:
                        known.update(x[:2] for x in found)
            return out

        def result(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], [], []))], ["a", "b", "na", "nb"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in ("of", "i", "j"))
            same = np.ones(batch.num_rows, dtype=bool)
            for c, v in zip(("of", "i", "j"), last, strict=True):
                same &= batch.column(c).to_numpy() == v
            cut = batch.num_rows - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield result(emitted(pa.Table.from_batches([*held, batch.slice(0, cut)])))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield result(emitted(pa.Table.from_batches(held)))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Two documents link when 100 * intersection >= percent * union of their shingle sets;
    ``component_id`` is the smallest id reachable by links, the document itself included.
    Components are what is found: links inside one that its other links imply are not
    searched for, so their number is not known.
    Null and empty texts and texts of white space have no shingles and their own id. A row
    whose id is null gets the component of rows with its very shingles, or null if none of
    them has an id.
    Repeated rows are answered once each. Other columns are ignored.
    """
    return _placed(docs, id_col, text_col, words, percent).select("doc_id", "n_shingles", "component_id")


def _placed(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, root`` of every row; root names the component, and is null without shingles."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    id_type = doc.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    for seed in range(SEEDS):
        signed = doc.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_signatures(words, seed), f"doc_id {id_type}, text_hash long, n_shingles long, cls long, check long, sketch array<long>")
        signatures = materialize(signed, "signatures")
        first_of = signatures.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("check", "n_shingles")).alias("least"), F.max(F.struct("check", "n_shingles")).alias("most"))
        first_of = materialize(first_of, "first")
        if first_of.filter("least <> most").isEmpty():
            break
        discard(signatures, first_of)
    else:
        raise RuntimeError(f"different sets share a name under {SEEDS} seeds")
    first_of = first_of.filter("doc_id is not null").select("cls", "doc_id")

    keys = doc.select("text").mapInArrow(_keys(words, percent, seed), "key long, cls long, note long")
    shared = materialize(_shared(keys, _busy(doc, words, percent)), "shared")
    release_shuffles(spark)
    stars = materialize(_stars(shared), "stars")
    discard(shared)
    release_shuffles(spark)
    pairs = stars.select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    wanted = stars.select("cls").unionByName(stars.select(F.col("lead").alias("cls"))).distinct()
    sketches = signatures.select("doc_id", "cls", F.col("n_shingles").alias("n"), "sketch")
    classes = materialize(sketches.join(wanted.join(first_of, "cls"), ["cls", "doc_id"]).dropDuplicates(["cls"]), "classes")
    near = materialize(_passing(pairs, classes, percent), "near")
    release_shuffles(spark)

    # each class against one star centre, then against its other centres that are still apart, then the rest
    first = near.groupBy("b").agg(F.min("a").alias("a"))
    links = _linked(doc, classes, near.join(first, ["a", "b"], "left_semi"), words, percent, seed)
    others = materialize(_apart(near, contracted(links)).join(first, ["a", "b"], "left_anti"), "near")
    links = materialize(links.unionByName(_linked(doc, classes, others, words, percent, seed)), "linked")
    roots = connected_components(links)
    rest = materialize(_open_pairs(stars, classes, roots, percent), "near")
    release_shuffles(spark)
    links = materialize(links.unionByName(_linked(doc, classes, rest, words, percent, seed)), "linked")
    roots = connected_components(links)
    discard(stars, classes, near, others, rest)
    release_shuffles(spark)

    of_class = first_of.join(roots.withColumnRenamed("node", "cls"), "cls")
    of_root = of_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = of_class.select("cls", "root").join(of_root, "root").select("cls", "component_id", "root")
    named = first_of.join(linked, "cls", "left").select("cls", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("root", "cls").alias("root"))
    # texts without shingles have no class: a key of their own keeps them from meeting in one task
    keyed = signatures.withColumn("cls", F.when(F.col("n_shingles") > 0, F.col("cls")).otherwise(F.xxhash64("doc_id")))
    whole = F.col("n_shingles") > 0
    return keyed.join(named, "cls", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce(F.when(whole, F.col("component_id")), "doc_id").alias("component_id"), F.when(whole, F.col("root")).alias("root"))


def _linked(doc: DataFrame, classes: DataFrame, near: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """The links among ``near``, written out; shingles are made again, only for the texts that it names."""
    named = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).distinct()
    chosen = classes.select("cls", "doc_id").join(named, "cls")
    sets = materialize(doc.join(chosen, "doc_id").select("text", "cls").mapInArrow(_sets(words, seed), "cls long, shingles array<long>"), "sets")
    links = materialize(_verified(near, sets, percent), "linked")
    discard(sets)
    release_shuffles(doc.sparkSession)
    return links


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    end = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root{x}"))
    joined = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    return joined.filter(F.coalesce("roota", "a") != F.coalesce("rootb", "b")).select(*pairs.columns)


def _open_pairs(stars: DataFrame, classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a part, are in different components and pass by their sketches; those with a part's lead are known."""
    placed = stars.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "lead", "cls", F.coalesce("root", "cls").alias("root"))
    in_blocks = lambda m: m * F.ceil(m / BLOCK_ROWS)
    mixed = placed.groupBy("key").agg(F.min("lead").alias("lead"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).filter("low <> high")
    open_ = materialize(placed.join(mixed.select("key"), "key"), "open")
    by_lead = open_.select("lead", "cls", "root").distinct()
    by_part = mixed.groupBy("lead").agg(F.sum(in_blocks(F.col("m"))).alias("by_part"))
    whole = by_lead.groupBy("lead").agg(F.count("*").alias("m")).join(by_part, "lead").select("lead", (in_blocks(F.col("m")) <= F.col("by_part")).alias("whole"))
    parts = mixed.join(whole.filter("not whole"), "lead").select("key")
    group = lambda rows, of, kind: rows.select(F.col(of).alias("of"), F.lit(kind).alias("kind"), "cls", "root")
    rows = group(by_lead.join(whole.filter("whole"), "lead"), "lead", 0).unionByName(group(open_.join(parts, "key"), "key", 1))

    # the classes of a group's largest component have sides of their own, which do not meet each other
    of_root = rows.groupBy("of", "kind", "root").agg(F.count("*").alias("n"))
    sizes = of_root.groupBy("of", "kind").agg(F.sum("n").alias("m"), F.max(F.struct("n", "root")).alias("top"))
    n_of = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    small = F.col("m") <= BLOCK_ROWS
    sizes = sizes.select("of", "kind", F.when(~small, F.col("top.root")).alias("top"), F.when(small, 1).otherwise(n_of(F.col("m") - F.col("top.n"))).alias("n_rest"), F.when(small, 0).otherwise(n_of(F.col("top.n"))).alias("n_top"))
    is_top = F.coalesce(F.col("root") == F.col("top"), F.lit(False))
    side = F.when(is_top, F.col("n_rest") + F.pmod(F.xxhash64("cls"), F.greatest("n_top", F.lit(1)))).otherwise(F.pmod(F.xxhash64("cls"), F.col("n_rest")))
    sided = rows.join(sizes, ["of", "kind"]).withColumn("side", side.cast("int"))
    dealt = sided.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_top, F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_top")) - 1)))
    dealt = dealt.select("of", (F.least("side", "other") * 2 + F.col("kind")).alias("i"), F.greatest("side", "other").alias("j"), "cls", "root", "side")
    compared = dealt.join(classes.select("cls", "n", "sketch"), "cls").repartition("of", "i", "j").sortWithinPartitions("of", "i", "j")
    return compared.mapInArrow(_blocks(percent), "a long, b long, na long, nb long").distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the smallest id.

    Where rows repeat that id one of the group's stays (that with the least text); rows of
    that id whose texts are no near-duplicates of each other are groups of their own.
    Documents without shingles stay, once for each id. Rows without an id stay.
    """
    found = _placed(docs, id_col, text_col, words, percent)
    kept = found.filter("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("text_hash").alias("text_hash"))
    kept = kept.groupBy("doc_id", "text_hash").agg(F.lit(True).alias("kept"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"))
    # copies of a row are told apart by their columns, but for maps, which have no order
    compared = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64(*compared))
    once = own.filter("doc_id is not null").join(kept, ["doc_id", "text_hash"], "left_semi").withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return once.select("row.*").unionByName(docs.filter(F.col(id_col).isNull()))
