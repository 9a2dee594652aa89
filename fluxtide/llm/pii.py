"""Personal data: strict patterns, and a linear-chain conditional random field beside them.

The patterns find the base spans.  The field reads words by their shape (digits, letters,
marks), its neighbours' shapes and its number of digits, is trained here from the small
labelled table below, and adds what the patterns lose: kinds that run into each other
(a phone number followed by a card number), numbers in spoken groups, and forms without a
country code.  A word without a digit or ``@`` can only be "outside": a hard constraint of
the field, so that a text falls into runs of the other words, and decoding each run between
two outside words is decoding the whole text.  Runs of one length are decoded together.
An added span must be valid for its kind and overlap no base span.

Defined cases: a null or empty text has no spans; repeated rows are treated alike; equal
path scores go to the label listed first; an empty table gives an empty table; other
columns are ignored.  No shuffle; a few megabytes of text at a time.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# The same matches in time linear in the text: an address is sought from its sign, whose local
# part is taken whole, and groups of digits are never entered in their midst.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]++@")
FIRST_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = re.compile(r"[0-9@]")

# The small labelled table: words, with the personal ones marked {kind:...}; # stands for
# any digit, drawn anew in each of the copies made of a line.
LABELLED = """
call {phone:+1 (###) ###-####} today
or {phone:+49 30 #######} and so on
by {phone:+33 # ## ## ## ##} until noon
ring {phone:+44 20 #### ####} now
at {phone:(###) ###-####} in town
from {phone:###-###-####} only
or {phone:###.###.####} then
{phone:+1 (###) ###-####} {card:################} was read
{card:################} {phone:+1 (###) ###-####} was read
{phone:+1 (###) ###-####} {ip:##.##.###.##} was read
{phone:+1 (###) ###-####} {phone:+1 (###) ###-####} twice
{card:################} {card:################} twice
{card:################} {ip:###.##.##.#} there
{ip:##.##.##.###} {card:################} there
{ip:##.###.##.##} {email:user.##@mail#.example.com} again
{email:user.##@mail#.example.com} {ip:##.#.##.###} again
{phone:+1 (###) ###-####} {email:user.##@mail#.example.com} again
{email:name##@host.org} {phone:+1 (###) ###-####} again
{email:user.##@mail#.example.com} {card:################} again
{card:################} {email:user.##@mail#.example.com} again
paid by {card:################} on time
paid by {card:#### #### #### ####} on time
paid by {card:####-####-####-####} on time
paid by {card:#### ###### #####} on time
{card:#### #### #### ####} {phone:+1 (###) ###-####} both
{phone:+1 (###) ###-####} {card:#### #### #### ####} both
{card:#### #### #### ####} {ip:##.##.###.##} both
mail {email:user.##@mail#.example.com} for it
mail {email:name@host.org} for it
mail {email:a.b-c@sub.host.co.uk} for it
from {ip:##.##.##.##} it came
from {ip:###.###.##.#} it came
about # times
about ## of
in #### there
for ### was
on ##.##.#### here
on ####-##-## here
version #.#.# of
version #.## of
at ##:## in
page ## ### of
was #,### of
was ### ### of
key AKIA##AB#CDEF##GHIJK in
key AKIAXX##QQ#RSTUV#WX# in
is password=a#bc##de###f#a## here
is password=##bc#de###f#a##ab here
is "##ab###cd##ef####ab##cd#ef####ab##cd#e##" then
is "a#b###cd##ef####ab##cd#ef####ab##cd#e##f" then
by @name in
at a@b in
# # # #
## ## ## ##
### #### #### of
is ####### of
of ########### in
"""
COPIES = 6
EPOCHS = 30


def shape(word: str) -> str:
    """Letters a, capitals A, digits 0, runs collapsed; other marks stay."""
    return re.sub(r"0+", "0", re.sub(r"[0-9]", "0", re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"[A-Z]+", "A", word))))[:24]


def word_features(words: list[str], i: int) -> list[str]:
    """Of one word in its text: own shape and length, and the two neighbours' shapes."""
    own, digits = words[i], sum(c.isdigit() and c.isascii() for c in words[i])
    plain = own.strip(".,;:!?\"'")
    near = lambda j: shape(words[j].strip(".,;:!?\"'")) if 0 <= j < len(words) and MARK.search(words[j]) else "-"
    letters = sum(c.isalpha() for c in own)
    return [f"s={shape(plain)}", f"d={min(digits, 20)}", f"l={min(letters, 3)}", f"@={'@' in own and '.' in own.rpartition('@')[2]}", f"+={plain[:1] if plain[:1] in '+(' else ''}", f"dots={min(plain.count('.'), 4)}", f"p={near(i - 1)}", f"n={near(i + 1)}", f"sd={shape(plain)}|{digits}", f"ps={near(i - 1)}|{shape(plain)}", "bias"]


def runs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Maximal runs of words with a digit or @."""
    start = None
    for i, word in enumerate(words):
        if MARK.search(word):
            start = i if start is None else start
        elif start is not None:
            yield start, i
            start = None
    if start is not None:
        yield start, len(words)


def labelled_rows(table: str = LABELLED, copies: int = COPIES, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of each copy of each line."""
    rng, rows = random.Random(seed), []
    for line in table.strip().split("\n"):
        for _ in range(copies):
            words, labels = [], []
            drawn = re.sub("#", lambda _: rng.choice("0123456789"), line)
            for kind, inside, plain in re.findall(r"\{(\w+):([^}]*)\}|(\S+)", drawn):
                parts = inside.split() if kind else [plain]
                words += parts
                labels += [f"{'BI'[i > 0]}-{kind}" if kind else "O" for i in range(len(parts))]
            rows.append((words, labels))
    return rows


class Field:
    """Weights: features x labels, label transitions, and those from and to the outside."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, words: list[str], start: int, stop: int) -> np.ndarray:
        return np.array([self.emit[[k for f in word_features(words, i) if (k := self.names.get(f)) is not None]].sum(0) for i in range(start, stop)])

    def decode(self, stacked: np.ndarray) -> np.ndarray:
        """Best labels of runs of one length: scores (runs, words, labels) -> (runs, words)."""
        n, length, _ = stacked.shape
        best = stacked[:, 0] + self.move[0]
        back = np.zeros((n, length, len(LABELS)), np.int8)
        for i in range(1, length):
            ways = best[:, :, None] + self.move[None]
            back[:, i] = ways.argmax(1)
            best = ways.max(1) + stacked[:, i]
        path = np.zeros((n, length), np.int8)
        path[:, -1] = (best + self.move[:, 0]).argmax(1)
        for i in range(length - 1, 0, -1):
            path[:, i - 1] = back[np.arange(n), i, path[:, i]]
        return path


def _allowed() -> np.ndarray:
    """I-k follows B-k or I-k only."""
    return np.array([[b[0] != "I" or a[2:] == b[2:] and a != "O" for b in LABELS] for a in LABELS])


def train(rows: list[tuple[list[str], list[str]]] | None = None, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood by AdaGrad over the runs of the labelled rows."""
    rows = labelled_rows() if rows is None else rows
    names: dict[str, int] = {}
    data = []
    for words, labels in rows:
        for start, stop in runs(words):
            feats = [[names.setdefault(f, len(names)) for f in word_features(words, i)] for i in range(start, stop)]
            data.append((feats, [LABELS.index(x) for x in labels[start:stop]]))
    emit, move = np.zeros((len(names), len(LABELS))), np.zeros((len(LABELS),) * 2)
    seen_e, seen_m = np.full_like(emit, 1e-2), np.full_like(move, 1e-2)
    barred = np.where(_allowed(), 0.0, -1e4)
    rng = random.Random(11)
    for _ in range(epochs):
        rng.shuffle(data)
        for feats, gold in data:
            trans = move + barred
            score = np.array([emit[f].sum(0) for f in feats])
            n = len(feats)
            ahead, behind = np.zeros_like(score), np.zeros_like(score)
            ahead[0] = trans[0] + score[0]
            for i in range(1, n):
                ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, None] + trans, 0) + score[i]
            behind[-1] = trans[:, 0]
            for i in range(n - 2, -1, -1):
                behind[i] = np.logaddexp.reduce(trans + score[i + 1] + behind[i + 1], 1)
            total = np.logaddexp.reduce(ahead[-1] + trans[:, 0])
            likely = np.exp(ahead + behind - total)
            g_move = np.zeros_like(move)
            g_move[0] -= likely[0]
            g_move[0, gold[0]] += 1
            g_move[:, 0] -= likely[-1]
            g_move[gold[-1], 0] += 1
            for i in range(1, n):
                g_move -= np.exp(ahead[i - 1][:, None] + trans + score[i] + behind[i] - total)
                g_move[gold[i - 1], gold[i]] += 1
            for i, f in enumerate(feats):
                g = -likely[i] - decay * emit[f]
                g[:, gold[i]] += 1
                seen_e[f] += g * g
                emit[f] += rate * g / np.sqrt(seen_e[f])
            g_move -= decay * move
            seen_m += g_move * g_move
            move += rate * g_move / np.sqrt(seen_m)
    return Field(names, emit, move + barred)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The check that a base match must pass."""
    if kind == "ip":
        return all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in text.split("."))
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def emails(text: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int]]:
    """The pattern's matches: from one's end on, what is left of a local part may begin another."""
    stop = len(text) if stop is None else stop
    m = FIRST_LOCAL.search(text, start, stop)
    while m:
        domain = DOMAIN.match(text, m.end(), stop)
        if domain:
            yield m.start(), domain.end()
        at = domain.end() if domain else m.end()
        m = domain and LOCAL.match(text, at, stop) or FIRST_LOCAL.search(text, at, stop)


def found_in(kind: str, text: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int]]:
    """Matches of a kind's shape, leftmost first, without overlaps."""
    stop = len(text) if stop is None else stop
    if kind == "email":
        yield from emails(text, start, stop)
    else:
        yield from (m.span() for m in SHAPES[kind].finditer(text, start, stop))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of kind, end) of all base matches, in order."""
    found = []
    for k, (kind, needs) in enumerate(zip(KINDS, ("@", ".", "", "+"))):
        if needs in text:
            spans = emails(text) if kind == "email" else (m.span() for m in (IP if kind == "ip" else PATTERNS[kind]).finditer(text))
            found += [(a, k, b) for a, b in spans if valid(kind, text[a:b])]
    return sorted(found)


# Shapes of what the field may add; a phone number may lack its country code.
SHAPES = {"ip": IP, "card": PATTERNS["card"], "phone": re.compile(r"(\+|\(?[0-9])[\x20().0-9-]+[0-9]")}


def added(text: str, words: list[re.Match], start: int, labels: np.ndarray, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Spans of one decoded run that are valid and new; their edges lose outer marks."""
    i, names = 0, [LABELS[x] for x in labels]
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    while i < len(names):
        j = i + 1
        if names[i] != "O":
            kind = names[i][2:]
            while j < len(names) and names[j] == f"I-{kind}":
                j += 1
            low, high = words[start + i].start(), words[start + j - 1].end()
            first, last = next(found_in(kind, text, low, high), (0, 0))
            span = text[first:last]
            if span and valid(kind, span) and (kind != "phone" or span[0] == "+" or sum(c.isdigit() for c in span) == 10) and (kind == "email" or not re.search(r"[A-Za-z]", text[low:high])):
                before = bisect_left(starts, last)  # base spans that begin before its end
                if not before or reach[before - 1] <= first:
                    yield first, KINDS.index(kind), last
        i = j


def find(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; runs are decoded in batches by length."""
    out: list[tuple[list, list]] = []
    waiting: dict[int, list] = defaultdict(list)
    for text in texts:
        if not text or not MARK.search(text):
            out.append(([], []))
            continue
        base = base_spans(text)
        entry = (base, list(base))
        out.append(entry)
        words = list(WORD.finditer(text))
        plain = [w[0] for w in words]
        for start, stop in runs(plain):
            waiting[stop - start].append((entry, text, words, start, field.scores(plain, start, stop)))
    for group in waiting.values():
        for (entry, text, words, start, _), labels in zip(group, field.decode(np.stack([g[-1] for g in group]))):
            if labels.any():
                entry[1].extend(added(text, words, start, labels, entry[0]))
    return [(base, sorted(spans)) for base, spans in out]


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per input row: id, base and spans as lists of (kind, start, end), in code
    points, end exclusive."""
    field = field or train()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    pack = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = find(batch.column("text").to_pylist(), field)
            lists = [pa.array([pack(f[i]) for f in found], pa.list_(span)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=[id_col, "base", "spans"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, base {kind}, spans {kind}")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from :func:`personal_spans`."""
    shown = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(found.columns[0], *[of(k) for k in KINDS], F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))
