"""Language-model scoring by a probabilistic suffix tree over words.

Learning counts every training word (A-Z lower-cased; an end after each text).  The tree's
alphabet is the words of relative frequency ``p_symbol`` or more, the end, and one class for
all other words, inside which a word has its add-one share.

*Short contexts.*  Level by level, contexts of up to ``order`` symbols and of relative frequency
``p_context`` or more get the counts of what follows them; a context is retained if its
next-symbol distribution diverges from that of its longest retained suffix by ``divergence``
nats or more.  These levels are broadcast; as their frequencies are relative, their size has a
proven bound at any corpus size: 1/p_symbol symbols, 1/p_context contexts and 1/p_emit entries a
level, 1/p_word words in the dictionary.

*Long contexts.*  Contexts of ``deep`` words: all that occur ``deep_least`` times or more, an
absolute number, and pass the same divergence test against the short levels are states, so what
is learned grows with the corpus, and a sequence that only a few of very many documents have is
learned at any size.  Most contexts occur once, and those need not move whole: blocks of texts
first send each segment of the hashes the leading bits of their contexts' hashes, some two bytes
a place, and get back a bit for each that may occur often enough.  Equal contexts have equal
bits, so none is lost, and a bit set in vain costs a few bytes.  The marked places go to the
segment of their context's hash, which counts contexts, tests them and sends each text what its
states gain.  Texts are stored in buckets of blocks, so that blocks meet their bits in place.

Distributions are discounted, what is taken or was rarer than ``p_emit`` goes to the suffix's
distribution, so each sums to one.  A text's score walks it with the longest suffix state known
at each place: short states from the broadcast levels, long ones from the segments.

Texts are read twice: to count words, and to write each as numbers of dictionary words, with
its words outside the dictionary.  All later passes read the numbers.

Defined cases: a null or empty text is one end; a null id counts as the empty string in the
split; repeated rows are learned and scored each; without training texts every token is
unknown and score equals base_score; words of equal count are ordered by their bytes; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import slices, written, written_by


@dataclass(frozen=True)
class Settings:
    p_word: float = 1e-6
    p_symbol: float = 5e-5
    p_context: float = 1e-5
    p_emit: float = 5e-7
    divergence: float = 0.02
    discount: float = 0.5
    order: int = 3
    deep: int = 6
    deep_share: int = 1  # one context in so many; 1: all
    deep_least: int = 2


def held_out(id_col: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' words, one text after the other, and where each text's begin (and the end)."""
    listed = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = listed.flatten().cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
    some = pc.binary_length(words).to_numpy() > 0  # blanks at a text's ends leave empty ones
    edges = np.concatenate(([0], np.cumsum(pc.list_value_length(listed).to_numpy())))
    return words if some.all() else words.filter(pa.array(some)), np.concatenate(([0], np.cumsum(some)))[edges]


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the training rows; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 32 << 20):
            words, _ = _words(batch.column("text"))
            found = words.value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "c"])

    return rows.filter("not held_out").select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Level:
    """Contexts of one length: their keys in the level before, and their entries."""

    keys: np.ndarray  # sorted: context before * symbols + symbol; a context's number is its place
    rest: np.ndarray  # by context: share left to the suffix; 1 where not retained
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted: context * symbols + next
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Tree:
    """Symbols 0..n-1 are words, then: any other word, the end, the beginning."""

    words: dict[bytes, int]  # the dictionary: word -> place
    symbol: np.ndarray  # of a dictionary word
    log_count: np.ndarray  # log10(c + 1) of a dictionary word
    root: np.ndarray
    levels: list[Level]
    n: int
    tokens: int
    kinds: int
    other_total: int
    ends: int
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # of a dictionary word

    @property
    def size(self) -> int:
        return self.n + 3

    def symbols_of(self, places: np.ndarray) -> np.ndarray:
        """Of dictionary places (-2: the end, other negatives: none)."""
        symbols = np.where(places >= 0, self.symbol[places] if len(self.symbol) else self.n, self.n)
        symbols[places == -2] = self.n + 1
        return symbols

    def contexts(self, symbols: np.ndarray, starts: np.ndarray, length: int) -> Iterator[np.ndarray]:
        """Of lengths 1, 2, ...: the context's number at each place, -1 if it has none."""
        before = np.empty_like(symbols)
        before[1:] = symbols[:-1]
        before[starts] = self.n + 2
        now = before
        yield now
        for level in self.levels[1:length]:
            key = np.full_like(now, -1)
            key[1:] = np.where(now[:-1] >= 0, now[:-1] * self.size + symbols[:-1], -1)
            key[starts] = -1
            now = _place(level.keys, key)
            yield now

    def chances_at(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """As ``chances``, at places that have as many symbols of their text before them as there are levels."""
        chance = self.root[symbols[at]]
        for length, level in enumerate(self.levels, 1):
            now = symbols[at - length]
            for k in range(1, length):
                now = np.where(now >= 0, now * self.size + symbols[at - length + k], -1)
                now = _place(self.levels[k].keys, now)
            known = np.flatnonzero(now >= 0)
            known = known[level.rest[now[known]] < 1.0]
            found = _place(level.entries, now[known] * self.size + symbols[at[known]])
            own = np.where(found >= 0, level.share[found] if len(level.share) else 0.0, 0.0)
            chance[known] = own + level.rest[now[known]] * chance[known]
        return chance

    def chances(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        chance = self.root[symbols]
        if not self.levels:
            return chance
        for level, now in zip(self.levels, self.contexts(symbols, starts, len(self.levels))):
            known = np.flatnonzero(now >= 0)
            known = known[level.rest[now[known]] < 1.0]
            at = _place(level.entries, now[known] * self.size + symbols[known])
            own = np.where(at >= 0, level.share[at] if len(level.share) else 0.0, 0.0)
            chance[known] = own + level.rest[now[known]] * chance[known]
        return chance


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted in sorted keys (none negative), -1 if missing."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    if len(wanted) > 2 * len(keys):
        return _hashed_place(keys, wanted)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _hashed_place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The same for many wanted: a slot that is taken sends a key to the next."""
    bits = (4 * len(keys)).bit_length()
    slot_of = lambda x: ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    slots, at = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
    left, slot = np.arange(len(keys)), slot_of(keys)
    while len(left):
        free = slots[slot] < 0
        slots[slot[free]], at[slot[free]] = keys[left[free]], left[free]
        moves = slots[slot] != keys[left]
        left, slot = left[moves], (slot[moves] + 1) % len(slots)
    slot = slot_of(wanted)
    found = slots[slot]
    out = np.where(found == wanted, at[slot], -1)
    left = np.flatnonzero((found != wanted) & (found >= 0) & (wanted >= 0))
    slot = slot[left]
    while len(left):
        slot = (slot + 1) % len(slots)
        found = slots[slot]
        hit = found == wanted[left]
        out[left[hit]] = at[slot[hit]]
        goes = ~hit & (found >= 0)
        left, slot = left[goes], slot[goes]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_contexts(each: np.ndarray, begun: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the chosen long contexts: a place's context is the ``deep`` words
    before it in its text; ``each`` are the words' hashes, ``begun`` a place's number in its text."""
    n = max(0, len(each) - settings.deep)
    found = np.full(n, settings.deep, np.uint64)
    for i in range(settings.deep):
        found = _mixed(found * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n])
    chosen = (begun[len(each) - n :] >= settings.deep) & ((found >> np.uint64(33)) % np.uint64(settings.deep_share) == 0)
    at = np.flatnonzero(chosen)
    return at + settings.deep, found[at]


CODED = "held_out boolean, n_tokens long, places binary, rare array<struct<word:binary,n:long>>, nth long"


def encoded(rows: DataFrame, tree: Tree) -> DataFrame:
    """(id, text, held_out) -> each text as dictionary places and an end, and its words outside
    the dictionary with their counts; the k-th of them has the place -3 - k.  nth is a text's
    number in its block of some megabytes."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(list(shared.value.words), pa.binary())
        for batch in slices(batches, "text"):
            words, edges = _words(batch.column("text"))
            words = words.cast(pa.binary())
            found = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
            missing = np.flatnonzero(found == -1)
            unknown = words.take(pa.array(missing)).to_pylist()
            kth, spelt, counts, kinds = [], [], [], [0]
            between = np.searchsorted(missing, edges).tolist()
            for low, high in zip(between, between[1:]):
                own: dict[bytes, int] = {}  # words outside the dictionary
                mine = [own.setdefault(w, len(own)) for w in unknown[low:high]]
                kth += mine
                spelt += own
                counts.append(np.bincount(mine) if mine else np.zeros(0, np.int64))
                kinds.append(len(spelt))
            places = found.astype(np.int32)
            places[missing] = -3 - np.array(kth, np.int32)
            ended = np.array([-2], np.int32).tobytes()
            pieces = [places[a:b].tobytes() + ended for a, b in zip(edges, edges[1:])]
            lengths = np.diff(edges) + 1
            rare = pa.StructArray.from_arrays([pa.array(spelt, pa.binary()), pa.array(np.concatenate(counts), pa.int64())], names=["word", "n"])
            rare = pa.ListArray.from_arrays(pa.array(kinds, pa.int32()), rare)
            columns = [batch.column("id"), batch.column("held_out"), pa.array(lengths, pa.int64()), pa.array(pieces, pa.binary()), rare, pa.array(np.arange(len(pieces)))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *[x.split()[0] for x in CODED.split(", ")]])

    return rows.select("id", "text", "held_out").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {CODED}")


def _unpacked(batch: pa.RecordBatch, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The rows' numbers one after the other, and where each row's begin (and the end)."""
    cells = batch.column(name).to_pylist()
    sizes = np.array([len(x) for x in cells], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(cells), kind), np.concatenate(([0], np.cumsum(sizes)))


def _followers(rows: DataFrame, tree: Tree, length: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the contexts of one length: total counts, and the sorted keys and counts of the
    entries that occur ``least`` times or more (1/p_emit of them at most)."""
    shared = rows.sparkSession.sparkContext.broadcast(replace(tree, words={}, hashes=np.zeros(0, np.uint64)))
    size = tree.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
            unique, at = np.unique(keys, return_inverse=True)
            return unique, np.bincount(at, counts, len(unique)).astype(np.int64)

        def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], names=["k", "c"])

        for batch in slices(batches, "places"):
            places, edges = _unpacked(batch, "places", np.int32)
            starts, symbols = edges[:-1], shared.value.symbols_of(places)
            *_, now = shared.value.contexts(symbols, starts, length)
            known = now >= 0
            parts.append(np.unique(now[known] * size + symbols[known], return_counts=True))
            if sum(len(k) for k, _ in parts) > 3_000_000:
                parts[:] = [merged()]
                if len(parts[0][0]) > 1_500_000:
                    yield from out(*parts[0])
                    parts.clear()
        if parts:
            yield from out(*merged())

    counted = rows.filter("not held_out").select("places").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
    counted = written(counted)
    context = F.floor(F.col("k") / size)
    totals = counted.groupBy(context.alias("x")).agg(F.sum("c").alias("c")).toPandas()
    kept = counted.filter(F.col("c") >= least).toPandas().sort_values("k")
    total = np.zeros(size if length == 1 else len(tree.levels[length - 1].keys), np.int64)
    total[totals["x"].to_numpy(np.int64)] = totals["c"].to_numpy(np.int64)
    return total, kept["k"].to_numpy(np.int64), kept["c"].to_numpy(np.int64)


def dictionary(rows: DataFrame, counts: DataFrame, settings: Settings = Settings()) -> Tree:
    """The tree's words, symbols and root.  rows: (text, held_out); counts: word_counts(rows),
    written."""
    ends = rows.filter("not held_out").count()
    row = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens, kinds = (row[0] or 0) + ends, row[1] + (ends > 0)
    known = counts.filter(F.col("c") >= max(1.0, settings.p_word * tokens)).toPandas() if tokens else None
    listed = sorted(zip((bytes(w) for w in known["word"]), known["c"].tolist())) if tokens else []
    c = np.array([n for _, n in listed], np.int64)
    often = np.flatnonzero(c >= settings.p_symbol * tokens) if len(c) else np.zeros(0, np.int64)
    n = len(often)
    symbol = np.full(len(c), n, np.int64)
    symbol[often] = np.arange(n)
    other = tokens - ends - int(c[often].sum())
    totals = np.concatenate((c[often], [other, ends, 0])).astype(float)
    root = (totals + 1.0) / (tokens + n + 2)
    root[n + 2] = 0.0  # the beginning is never next
    hashes = np.array([xxhash.xxh64_intdigest(w, seed=42) for w, _ in listed], np.uint64)
    return Tree({w: i for i, (w, _) in enumerate(listed)}, symbol, np.log10(c + 1.0), root, [], n, tokens, kinds, other + (kinds - n - (ends > 0)) + 1, ends, hashes)


def learn(rows: DataFrame, counts: DataFrame, settings: Settings = Settings()) -> Tree:
    """The tree with its short levels."""
    tree = dictionary(rows, counts, settings)
    return grown(tree, written(encoded(rows.withColumn("id", F.lit(0)), tree)), settings)


def grown(tree: Tree, coded: DataFrame, settings: Settings) -> Tree:
    """Adds the short levels, from the training texts' numbers."""
    tokens, rows = tree.tokens, coded
    if not tokens:
        return tree

    keys = np.arange(tree.size, dtype=np.int64)
    suffix = np.zeros(tree.size, np.int64)  # of the context, as a context of the level before
    for length in range(1, settings.order + 1):
        tree.levels.append(Level(keys, np.ones(len(keys))))
        if not len(keys):
            break
        total, entries, seen = _followers(rows, tree, length, max(2.0, settings.p_emit * tokens))
        of, following = entries // tree.size, entries % tree.size
        share = (seen - settings.discount) / total[of]
        rest = 1.0 - np.bincount(of, share, len(keys))
        below = _below(tree, suffix[of], following, length - 1)
        own = share + rest[of] * below
        far = np.bincount(of, own * np.log(own / below), len(keys)) + np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-12)), 0.0) * (1.0 - np.minimum(np.bincount(of, below, len(keys)), 1.0))
        retained = (far >= settings.divergence) & (total > 0)
        stay = retained[of]
        tree.levels[-1] = Level(keys, np.where(retained, rest, 1.0), entries[stay], share[stay])
        # The next level's contexts are the frequent entries, the end apart.
        grow = (seen >= settings.p_context * tokens) & (following != tree.n + 1)
        longer = entries[grow]
        if length == 1:
            suffix = longer % tree.size
        else:
            suffix = _place(keys, suffix[longer // tree.size] * tree.size + longer % tree.size)
        keys = longer[suffix >= 0]
        suffix = suffix[suffix >= 0]
    return tree


def _below(tree: Tree, contexts: np.ndarray, following: np.ndarray, length: int) -> np.ndarray:
    """Chance of the symbols in the given contexts of one length, by all levels up to it."""
    if not length:
        return tree.root[following]
    level = tree.levels[length - 1]
    if length == 1:
        lower = tree.root[following]
    else:
        pair = level.keys[contexts]
        before = pair // tree.size
        last = pair % tree.size
        shorter = last if length == 2 else _place(tree.levels[length - 2].keys, _suffix_of(tree, before, length - 1) * tree.size + last)
        lower = _below(tree, shorter, following, length - 1)
    at = _place(level.entries, contexts * tree.size + following)
    return np.where(at >= 0, level.share[at] if len(level.share) else 0.0, 0.0) + level.rest[contexts] * lower


def _suffix_of(tree: Tree, contexts: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the contexts without their first symbol, one level below."""
    pair = tree.levels[length - 1].keys[contexts]
    last = pair % tree.size
    if length == 2:
        return last
    return _place(tree.levels[length - 2].keys, _suffix_of(tree, pair // tree.size, length - 1) * tree.size + last)


SEGMENT, SEGMENTS, LARGEST = 1 << 16, 4096, 1 << 21  # places of a segment, about; segments before they grow, and how far
LOGS = float(1 << 27)  # steps of a chance's logarithm


def _segments(tree: Tree) -> int:
    return max(1, min(-(-tree.tokens // SEGMENT), SEGMENTS), tree.tokens // LARGEST)


def varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers in groups of seven bits, low ones first, and where each begins (and the end)."""
    sizes = np.ones(len(numbers), np.int64)
    for k in range(1, 10):
        sizes += numbers >= np.uint64(1 << 7 * k)
    begun = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(begun[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > k)
        out[begun[some] + k] = (numbers[some] >> np.uint64(7 * k) & np.uint64(127)) | np.where(sizes[some] > k + 1, np.uint64(128), np.uint64(0))
    return out, begun


def numbers_of(packed: np.ndarray) -> np.ndarray:
    """The numbers that ``varints`` packed."""
    if not len(packed):
        return np.zeros(0, np.uint64)
    begun = np.concatenate(([0], np.flatnonzero(packed[:-1] < 128) + 1))
    nth = np.arange(len(packed)) - np.repeat(begun, np.diff(begun, append=len(packed)))
    return np.add.reduceat((packed & 127).astype(np.uint64) << (7 * nth).astype(np.uint64), begun)


@dataclass
class Block:
    """A block's texts, and its places that have a long context, by the contexts' hashes."""

    starts: np.ndarray  # of the texts
    symbols: np.ndarray
    at: np.ndarray
    ctx: np.ndarray  # sorted
    text: np.ndarray  # the text's number in the block
    trained: np.ndarray  # whether it is a training text
    segment: np.ndarray
    cuts: np.ndarray  # where segments begin, and the end


def _block(texts: pa.Table, tree: Tree, settings: Settings) -> Block:
    batch = texts.take(pc.sort_indices(texts["row"])).combine_chunks()
    places, edges = _unpacked(batch, "places", np.int32)
    starts, lengths = edges[:-1], np.diff(edges)
    text = np.repeat(np.arange(len(starts)), lengths)
    each = np.where(places >= 0, tree.hashes[places] if len(tree.hashes) else np.uint64(0), np.uint64(1))
    rare = pa.concat_arrays(batch["rare"].chunks)
    first = np.concatenate(([0], np.cumsum(pc.list_value_length(rare).to_numpy(zero_copy_only=False))))
    spelt = rare.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    missing = np.flatnonzero(places < -2)
    each[missing] = spelt[first[text[missing]] - 3 - places[missing]]
    at, ctx = long_contexts(each, np.arange(len(places)) - starts[text], settings)
    order = np.argsort(ctx)
    at, ctx = at[order], ctx[order]
    segment = ((ctx >> np.uint64(32)) * np.uint64(_segments(tree)) >> np.uint64(32)).astype(np.int32)
    trained = ~batch["held_out"].to_numpy().astype(bool)
    cuts = np.append(np.flatnonzero(np.diff(segment, prepend=-1)), len(at))
    return Block(starts, tree.symbols_of(places), at, ctx, text[at], trained[text[at]], segment[cuts[:-1]], cuts)


def _by_segment(run: Callable[[int, list[tuple]], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls ``run`` for each segment of rows that are sorted by it."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []
        for batch in batches:
            for segment, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != last and group:
                    yield run(last, group)
                    group = []
                last = segment
                group.append(rest)
        if group:
            yield run(last, group)

    return over


def hashed(coded: DataFrame) -> DataFrame:
    """What blocks read: of the words outside the dictionary their hashes (XXH64, seed 42, as the dictionary's)."""
    return coded.select("block", "row", "held_out", "places", F.transform("rare", lambda r: F.xxhash64(r["word"])).alias("rare"))


def marked_places(coded: DataFrame, tree: Tree, settings: Settings) -> DataFrame:
    """(block, segment, marks): a bit for each place of a block whose context is in the segment,
    in the order of the hashes.  It is set if the training texts have the leading bits of the
    hash ``deep_least`` times or more; there are at least 32 values of them for each token."""
    shared = coded.sparkSession.sparkContext.broadcast(replace(tree, words={}, levels=[]))
    shift = np.uint64(max(0, 64 - (32 * tree.tokens).bit_length()))

    def send(texts: pa.Table) -> pa.Table:
        b = _block(texts, shared.value, settings)
        seen = b.ctx >> shift
        steps = np.diff(seen, prepend=np.uint64(0))
        steps[b.cuts[:-1]] = seen[b.cuts[:-1]]
        packed, begun = varints(steps)
        cells = [pa.array([x.tobytes() for x in made], pa.binary()) for made in ((packed[begun[i] : begun[j]] for i, j in zip(b.cuts, b.cuts[1:])), (np.packbits(b.trained[i:j]) for i, j in zip(b.cuts, b.cuts[1:])))]
        block = np.full(len(b.segment), texts["block"][0].as_py(), np.int64)
        return pa.table([pa.array(b.segment), pa.array(block), *cells], names=["segment", "block", "seen", "trained"])

    def mark(segment: int, group: list[tuple]) -> pa.RecordBatch:
        packed = [np.frombuffer(g[1], np.uint8) for g in group]
        sizes = np.array([np.count_nonzero(x < 128) for x in packed])
        begun = np.concatenate(([0], np.cumsum(sizes)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(numbers_of(np.concatenate(packed)))))
        seen = total[1:] - np.repeat(total[begun[:-1]], sizes)
        trained = np.concatenate([np.unpackbits(np.frombuffer(g[2], np.uint8), count=n) for g, n in zip(group, sizes)])
        order = np.argsort(seen, kind="stable")
        first = np.concatenate(([True], np.diff(seen[order]) != 0))
        enough = np.add.reduceat(trained[order].astype(np.int64), np.flatnonzero(first)) >= settings.deep_least
        marks = np.empty(len(seen), bool)
        marks[order] = enough[np.cumsum(first) - 1]
        some = [i for i, (a, z) in enumerate(zip(begun, begun[1:])) if marks[a:z].any()]
        cells = pa.array([np.packbits(marks[begun[i] : begun[i + 1]]).tobytes() for i in some], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([group[i][0] for i in some], pa.int64()), pa.array([segment] * len(some), pa.int32()), cells], names=["block", "segment", "marks"])

    sent = coded.groupBy("block").applyInArrow(send, "segment int, block long, seen binary, trained binary")
    return sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(_by_segment(mark), "block long, segment int, marks binary")


def deep_places(coded: DataFrame, marked: DataFrame, tree: Tree, settings: Settings) -> DataFrame:
    """(segment, block, ctx, s, p, at): the marked places, by segments of their context's hash.  A
    row holds the places of one block of texts, as packed numbers: six bytes of the hash (the
    segment has the others), twice the symbol (and one in training texts), the logarithm of the
    short levels' chance, and the text's number in its block."""
    shared = coded.sparkSession.sparkContext.broadcast(replace(tree, words={}))
    schema = pa.schema([("segment", pa.int32()), ("block", pa.int64()), *((x, pa.binary()) for x in ("ctx", "s", "p", "at"))])

    def run(texts: pa.Table, marked: pa.Table) -> pa.Table:
        if not (texts.num_rows and marked.num_rows):
            return schema.empty_table()
        tree = shared.value
        b = _block(texts, tree, settings)
        kept = np.zeros(len(b.at), bool)
        spans = dict(zip(b.segment.tolist(), zip(b.cuts.tolist(), b.cuts[1:].tolist())))
        for segment, bits in zip(marked["segment"].to_pylist(), marked["marks"].to_pylist()):
            low, high = spans[segment]
            kept[low:high] = np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low)
        at, ctx, text = b.at[kept], b.ctx[kept], b.text[kept]
        chance = tree.chances_at(b.symbols, at) if settings.deep >= len(tree.levels) else tree.chances(b.symbols, b.starts)[at]
        columns = [
            ctx.view(np.uint8).reshape(-1, 8)[:, :6],
            (2 * b.symbols[at] + b.trained[kept]).astype(np.uint16 if 2 * tree.size <= 1 << 16 else np.uint32),
            np.round(np.minimum(-np.log10(chance) * LOGS, 2.0**32 - 1)).astype(np.uint32),
            text.astype(np.uint16 if len(b.starts) <= 1 << 16 else np.uint32),
        ]
        segment = np.repeat(b.segment, np.diff(b.cuts))[kept]
        cuts = np.append(np.flatnonzero(np.diff(segment, prepend=-1)), len(at))
        packed = [pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for x in columns]
        block = np.full(len(cuts) - 1, texts["block"][0].as_py(), np.int64)
        return pa.table([pa.array(segment[cuts[:-1]]), pa.array(block), *packed], schema=schema)

    return coded.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(run, "segment int, block long, ctx binary, s binary, p binary, at binary")


def _gained(key: np.ndarray, s: np.ndarray, p: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Of all places of some contexts: which stand in a retained context, and by how much it
    raises their log10 probability.  s: twice the symbol, and one in training texts."""
    order = np.lexsort((s, key))
    key, trained, symbol, p = key[order], (s[order] & 1).astype(np.int64), s[order] >> 1, 10.0 ** -(p[order] / LOGS)
    context = np.concatenate(([True], key[1:] != key[:-1]))
    entry = context | np.concatenate(([True], symbol[1:] != symbol[:-1]))
    begun = np.flatnonzero(entry)
    c, p, of = np.add.reduceat(trained, begun), p[begun], np.cumsum(context)[begun] - 1
    seen = c > 0
    total, kinds, below = (np.bincount(of, x) for x in (c, seen, p * seen))
    rest = settings.discount * kinds / np.maximum(total, 1)
    own = np.where(seen, (c - settings.discount) / np.maximum(total, 1)[of], 0.0) + rest[of] * p
    gain = np.log(np.where(own > 0, own, p) / p)
    far = np.bincount(of, own * gain * seen) + rest * np.log(np.where(rest > 0, rest, 1.0)) * np.maximum(1.0 - below, 0.0)
    retained = (total >= settings.deep_least) & (far >= settings.divergence)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(entry) - 1
    return retained[of][back], gain[back] / np.log(10.0)


def deep_gains(coded: DataFrame, tree: Tree, settings: Settings) -> DataFrame:
    """(row, gain, n_deep): by how much long contexts raise each text's log10 probability, and at
    how many places.  A segment sends a block of texts one row."""

    def gains(segment: int, group: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(g[1]) // 6 for g in group])
        key = np.zeros((int(sizes.sum()), 8), np.uint8)
        key[:, :6] = np.frombuffer(b"".join(g[1] for g in group), np.uint8).reshape(-1, 6)
        number = lambda i: np.concatenate([np.frombuffer(g[i], f"u{len(g[i]) // n}").astype(np.int64) for g, n in zip(group, sizes)])
        held, gain = _gained(key.view(np.uint64).ravel(), number(2), number(3), settings)
        texts, of = np.unique((np.repeat(np.arange(len(group)), sizes) << 32 | number(4))[held], return_inverse=True)
        sums, places = np.bincount(of, gain[held], len(texts)), np.bincount(of, minlength=len(texts)).astype(np.uint32)
        cuts = np.searchsorted(texts >> 32, np.arange(len(group) + 1))
        some = np.flatnonzero(np.diff(cuts))
        packed = [pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()) for x in ((texts & 0xFFFFFFFF).astype(np.uint32), sums, places)]
        return pa.RecordBatch.from_arrays([pa.array([group[i][0] for i in some], pa.int64()), *packed], names=["block", "at", "gain", "n"])

    def add(table: pa.Table) -> pa.Table:
        at, gain, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("at", np.uint32), ("gain", np.float64), ("n", np.uint32)))
        some = np.unique(at)
        row = some.astype(np.int64) + table.column("block")[0].as_py()
        return pa.table({"row": row, "gain": np.bincount(at, gain)[some], "n_deep": np.bincount(at, n)[some].astype(np.int64)})

    texts = hashed(coded)
    marked = written(marked_places(texts, tree, settings))
    dealt = deep_places(texts, marked, tree, settings).repartition("segment").sortWithinPartitions("segment")
    sent = dealt.mapInArrow(_by_segment(gains), "block long, at binary, gain binary, n binary")
    return sent.groupBy("block").applyInArrow(add, "row long, gain double, n_deep long")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), split: Column | None = None) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, n_deep (places scored from long contexts).  ``split`` says which rows are held out (by
    default the fold of the contract)."""
    split = held_out(F.col(id_col)) if split is None else split
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), split.alias("held_out"))
    id_type = rows.schema["id"].dataType.simpleString()
    counts = written(word_counts(rows))
    tree = dictionary(rows, counts, settings)
    coded = encoded(rows, tree).withColumn("row", F.monotonically_increasing_id())
    coded = written_by(coded.withColumn("block", F.col("row") - F.col("nth")).drop("nth"), "block")
    tree = grown(tree, coded, settings)
    shared = docs.sparkSession.sparkContext.broadcast(replace(tree, words={}, hashes=np.zeros(0, np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in slices(batches, "places"):
            places, edges = _unpacked(batch, "places", np.int32)
            starts, symbols = edges[:-1], tree.symbols_of(places)
            chances = tree.chances(symbols, starts) if tree.tokens else np.ones(len(places))
            found = np.where(places >= 0, tree.log_count[places] if len(tree.log_count) else 0.0, 0.0)
            base = found + np.where(places == -2, math.log10(tree.ends + 1.0), 0.0)
            logs = np.log10(chances) + np.where(symbols == tree.n, found, 0.0)
            sums = [np.add.reduceat(x, starts) for x in (base, logs, (places >= 0).astype(np.int64), (symbols == tree.n).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "held_out", "row", "n_tokens")], *map(pa.array, sums)], names=["id", "held_out", "row", "n_tokens", "base", "logs", "known", "other"])

    schema = f"id {id_type}, held_out boolean, row long, n_tokens long, base double, logs double, known long, other long"
    walked = coded.select("id", "held_out", "row", "n_tokens", "places").mapInArrow(run, schema)
    tail = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts, "word")
    tail = tail.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("tail"), F.sum("n").alias("tail_known"))
    out = walked.join(tail, "row", "left")
    if tree.tokens:
        out = out.join(deep_gains(coded, tree, settings), "row", "left")
    else:
        out = out.withColumns({"gain": F.lit(0.0), "n_deep": F.lit(0)})
    out = out.withColumns({"tail": F.coalesce("tail", F.lit(0.0)), "gain": F.coalesce("gain", F.lit(0.0))})
    base = F.col("base") + F.col("tail") - F.col("n_tokens") * math.log10(tree.tokens + tree.kinds + 1.0)
    own = F.col("logs") + F.col("tail") + F.col("gain") - F.col("other") * math.log10(tree.other_total) if tree.tokens else base
    known = F.col("known") + F.coalesce("tail_known", F.lit(0)) + int(tree.ends > 0)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(tree.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), own.alias("score"), F.coalesce("n_deep", F.lit(0)).cast("long").alias("n_deep"))
