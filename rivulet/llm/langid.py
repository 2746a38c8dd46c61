"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built; it recognises exactly the substrings of that text. A
text is parsed against it greedily: from each phrase's start the automaton follows the characters as long as they occur
in the labelled text (the longest match), where the next phrase starts. The fewer phrases, the better the language's
text predicts this one. The language with fewest wins. As phrases grow with the logarithm of the labelled text, those of
languages with samples of other lengths are weighted by it. A letter that a language's sample doesn't hold has to be named
among all code points instead of pointed at in a sample, so it counts by the logarithm of their number: more than a phrase
of one held letter. Samples under ``SHORT_CHARS`` count as that long: the law doesn't hold for less.

Texts are parsed whole, case-folded, with runs of anything but letters and combining marks as one blank. All texts of an Arrow batch step through all
automata together, one character a step, as numpy vectors over one sparse transition table. A text longer than ``BLOCK``
characters is stepped through in blocks at once, as if each began a phrase; then every block is parsed again from the
state in which the block before it ended, up to where both parses meet (mostly a few phrases on), so the count is that of
one parse from the text's start, whatever the block's size. Every letter that a sample holds has a class of its own,
whatever the number of scripts.

Learning is bounded: per language at most ``SAMPLE_CHARS`` characters of labelled documents that hold a letter, in an
order of hashed ids; the document that reaches the bound is cut there. Every label with such a document is learned. The
automata are built from that sample, once per Python process.

Defined results: a null text or one without a letter gives ``und`` with score 0. Ties go to the language first in
alphabetical order. Without labelled text every row is ``und``. Repeated rows each give a row. An empty table gives an
empty result. Extra columns are kept, but for those with the names of the new columns, which are replaced.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import slices

#: Bound of the sample of labelled text per language, in normalised characters.
SAMPLE_CHARS = 40_000
#: Length of sample from which on phrases are weighted by its logarithm.
SHORT_CHARS = 5_000
#: Labelled documents per language that are looked at for the sample at first; more where they don't fill it.
SAMPLE_DOCS = 120
#: What a letter that no sample holds costs, as a phrase costs the logarithm of its sample's length.
FOREIGN = math.log(0x110000)
#: Characters of a block; it sets how many steps are taken at once and doesn't change results.
BLOCK = 2048
#: Places tried for a state's transitions before they go to the end of the table.
_TRIES = 16
UNDETERMINED = "und"

_MODELS: dict = {}


class SuffixAutomaton:
    """Of a sequence of small integers; ``next`` has a dictionary of transitions per state."""

    def __init__(self, sequence):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] == self.length[p] + 1:
                self.link[state] = q
            else:
                clone = len(self.next)
                self.next.append(dict(self.next[q]))
                self.link.append(self.link[q])
                self.length.append(self.length[p] + 1)
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = clone
                    p = self.link[p]
                self.link[q] = self.link[state] = clone
        return state


def letters_table() -> np.ndarray:
    """Per code point: the folded letter's code point, or 32 for anything that isn't a letter or a mark."""
    table = np.full(0x110000, 32, np.int32)
    for cp in range(0x110000):
        char = chr(cp)
        if char.isalpha():
            low = char.lower()
            table[cp] = ord(low[0])
        elif unicodedata.category(char) in ("Mn", "Mc"):
            table[cp] = cp
    return table


_LETTERS: list[np.ndarray] = []


def _marks(points: np.ndarray) -> np.ndarray:
    """Which of the folded code points are marks and no letters."""
    found = np.unique(points)
    return np.isin(points, found[[not chr(c).isalpha() and c != 32 for c in found.tolist()]])


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters with single blanks between words, of all texts; and the texts' offsets."""
    if not _LETTERS:
        _LETTERS.append(letters_table())
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _LETTERS[0][points]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    gap = folded == 32
    kept = np.ones(len(folded), bool)
    kept[1:] = ~(gap[1:] & gap[:-1])
    kept[0] = not gap[0]
    starts = ends[:-1]
    kept[starts] &= ~gap[starts]  # a text doesn't begin with a blank
    kept[ends - 1] = False  # the separators
    at = np.concatenate([[0], np.cumsum(kept)[ends - 1]])
    return folded[kept], at


def displaced(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset per state, owner and target per slot): the transition of state s by c is in slot offset[s] + c if that
    slot's owner is s, else there is none. Symbols are below ``width``. The root (state 0) is left out."""
    used = bytearray(b"\1" * width)  # never used: so no offset is below 0
    offset = np.zeros(len(rows), np.int64)
    low = width
    several = sorted((s for s in range(1, len(rows)) if len(rows[s]) > 1), key=lambda s: -len(rows[s]))
    for s in several:
        symbols = sorted(rows[s])
        first, last = symbols[0], symbols[-1]
        at, tries = low, 0
        while True:
            at = used.find(0, at)
            if at < 0 or tries == _TRIES:
                at = len(used)
            if len(used) < at - first + last + 1:
                used.extend(bytes(at - first + last + 1 - len(used)))
            if not any([used[at - first + c] for c in symbols]):
                break
            at, tries = at + 1, tries + 1
        if tries == _TRIES:
            low = used.find(0, low + 1)
            low = len(used) if low < 0 else low
        offset[s] = at - first
        for c in symbols:
            used[at - first + c] = 1
    one = np.array([s for s in range(1, len(rows)) if len(rows[s]) == 1], np.int64)
    free = np.flatnonzero(np.frombuffer(used, np.uint8) == 0)[: len(one)]
    free = np.concatenate([free, np.arange(len(used), len(used) + len(one) - len(free))])
    offset[one] = free - np.array([next(iter(rows[s])) for s in one.tolist()], np.int64)
    state = np.repeat(np.arange(1, len(rows)), [len(x) for x in rows[1:]])
    symbol = np.fromiter((c for x in rows[1:] for c in x), np.int64, len(state))
    slot = offset[state] + symbol
    owner = np.full(max(len(used), int(slot.max(initial=0)) + 1) + width, -1, np.int64)
    target = np.zeros(len(owner), np.int64)
    owner[slot] = state
    target[slot] = np.fromiter((t for x in rows[1:] for t in x.values()), np.int64, len(state))
    return offset, owner, target


class Model:
    """The languages, the classes of characters (0 for what no sample holds, 1 for the blank) and one table for all
    automata."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        parts = [normalised([samples[lang]])[0] for lang in self.languages]
        every = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        letters, counts = np.unique(every[every != 32], return_counts=True)
        letters = letters[np.argsort(-counts, kind="stable")]
        width = 2 + len(letters)
        self.classes = np.zeros(0x110000, np.uint32)
        self.classes[32] = 1
        self.classes[letters] = np.arange(2, width, dtype=np.uint32)
        offsets, slots, self.starts, base, begin = [], [], [], 0, 0
        #: Per language and class the state after a new phrase's first character: the one between phrases if it isn't held.
        self.first = np.zeros((len(parts), width), np.uint32)
        for i, part in enumerate(parts):
            automaton = SuffixAutomaton(self.classes[part].tolist())
            n = len(automaton.next)  # also the number of one more state, between phrases, without transitions
            self.first[i] = base + n
            for c, s in automaton.next[0].items():
                self.first[i, c] = base + s
            offset, owner, target = displaced(automaton.next, width)
            offsets += [offset + begin, [begin]]
            owner = np.where(owner < 0, 0xFFFFFFFF, owner + base)
            slots.append(np.stack([target + base, owner], axis=1).astype(np.uint32))
            self.starts.append(base + n)
            base, begin = base + n + 1, begin + len(owner)
        lengths = np.log(np.maximum([len(part) for part in parts], SHORT_CHARS))
        self.weights = lengths / lengths.max(initial=1.0)
        self.foreign_weight = FOREIGN / lengths.max(initial=1.0)
        self.offsets = np.concatenate(offsets).astype(np.int64) if parts else np.zeros(0, np.int64)
        self.slots = np.concatenate(slots).view(np.uint64).ravel() if parts else np.zeros(0, np.uint64)

    def _next(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a state has no transition by its symbol, the state after it)."""
        found = self.slots.take(self.offsets.take(state) + symbol).view(np.uint32).reshape(*state.shape, 2)
        return found[..., 1] != state, found[..., 0]

    def phrases(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases per row and language."""
        lengths = np.diff(at)
        row = np.repeat(np.arange(len(lengths)), -(-lengths // BLOCK))
        first = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(at[:-1], at[1:], strict=True)]) if len(row) else np.zeros(0, np.int64)
        size = np.minimum(first + BLOCK, at[1:][row]) - first
        order = np.argsort(-size, kind="stable")
        k, n = len(self.languages), len(row)
        found = np.zeros((len(lengths), k), np.int64)
        if n == 0 or k == 0:
            return found
        begin, length = first[order], size[order]
        state = np.repeat(np.asarray(self.starts, np.uint32)[:, None], n, axis=1)
        count, ends = np.zeros((k, n), np.int64), np.zeros((k, n), np.uint32)
        active = n
        alive = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # blocks longer than each step
        for step in range(int(length[0])):
            if alive[step] != active:
                ends[:, alive[step] : active] = state[:, alive[step] :]
                active = int(alive[step])
                state = np.ascontiguousarray(state[:, :active])
            symbol = classes[begin[:active] + step]
            fresh, after = self._next(state, symbol)
            count[:, :active] += fresh
            state = np.where(fresh, self.first.take(symbol, axis=1), after)
        ends[:, :active] = state
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        count, ends = count[:, back], ends[:, back]  # in the order of the texts
        self._carry(classes, row, first, size, count, ends)
        np.add.at(found, row, count.T)
        return found

    def _carry(self, classes: np.ndarray, row: np.ndarray, first: np.ndarray, size: np.ndarray, count: np.ndarray, ends: np.ndarray) -> None:
        """Make the counts and end states of blocks those of parses that go on from the block before."""
        lang, block = np.nonzero(np.repeat(np.concatenate([[False], row[1:] == row[:-1]])[None, :], len(count), axis=0))
        alone, alone_ends = count.copy(), ends.copy()
        while len(lang):
            state = ends[lang, block - 1]
            fresh_state = np.asarray(self.starts, np.uint32)[lang]
            on, change, ended = np.arange(len(lang)), np.zeros(len(lang), np.int64), alone_ends[lang, block]
            step = 0
            while len(on):
                over = size[block[on]] == step
                if over.any():
                    ended[on[over]] = state[over]
                    on, state, fresh_state = on[~over], state[~over], fresh_state[~over]
                    if len(on) == 0:
                        break
                symbol = classes[first[block[on]] + step]
                begun = self.first[lang[on], symbol]
                a, x = self._next(state, symbol)
                b, y = self._next(fresh_state, symbol)
                change[on] += a.astype(np.int64) - b
                state, fresh_state = np.where(a, begun, x), np.where(b, begun, y)
                apart = state != fresh_state
                on, state, fresh_state = on[apart], state[apart], fresh_state[apart]
                step += 1
            count[lang, block] = alone[lang, block] + change
            # a block that ends in another state than was thought is what the next one has to go on from
            moved = ended != ends[lang, block]
            ends[lang[moved], block[moved]] = ended[moved]
            last = np.concatenate([row[1:] != row[:-1], [True]])
            moved &= ~last[block]
            lang, block = lang[moved], block[moved] + 1

    def foreign(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Characters per row and language that the language's sample doesn't hold; each is a phrase."""
        found = np.zeros((len(at) - 1, len(self.languages)), np.int64)
        for i, start in enumerate(self.starts):
            total = np.concatenate([[0], np.cumsum((self.first[i] == start)[classes])])
            found[:, i] = total[at[1:]] - total[at[:-1]]
        return found

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        letters, at = normalised(texts)
        has = np.concatenate([[0], np.cumsum((letters != 32) & ~_marks(letters))])
        has = has[at[1:]] > has[at[:-1]]
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        classes = self.classes[letters]
        count = self.phrases(classes, at).astype(np.float64)
        alone = self.foreign(classes, at)
        count = (count - alone) * self.weights + alone * self.foreign_weight
        best = np.argmin(count, axis=1)
        least = count[np.arange(len(texts)), best]
        others = count.copy()
        others[np.arange(len(texts)), best] = np.inf
        second = others.min(axis=1) if count.shape[1] > 1 else np.maximum(1, np.diff(at))
        score = np.where(has, np.clip(1 - least / np.maximum(second, 1), 0, 1), 0.0)
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best.tolist(), has.tolist(), strict=True)], score.tolist()


def model(samples: dict[str, str]) -> Model:
    """One model per sample and Python process."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode("utf-8", "surrogatepass")).digest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(samples)
    return _MODELS[key]


def _drawn(rows: DataFrame, shares: dict, sample_chars: int, key: str, text: str, lang: str) -> dict[str, tuple[list[str], int]]:
    """Per language the texts of a share of its rows, in order of hashed keys, up to the one that fills the sample; and how
    many letters and marks they have."""
    modulus = 1_000_000_007
    limits = rows.sparkSession.createDataFrame([(name, int(min(1.0, share) * modulus)) for name, share in shares.items()], T.StructType([T.StructField("lang", rows.schema[lang].dataType), T.StructField("most", T.LongType())]))
    spread = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(modulus))
    picked = rows.select(F.col(lang).alias("lang"), spread.alias("h"), F.col(key).cast("string").alias("k"), F.substring(text, 1, 4 * sample_chars).alias("text"))
    picked = picked.join(F.broadcast(limits), "lang").filter("h <= most").withColumn("size", F.length(F.regexp_replace("text", r"[^\p{L}\p{Mn}\p{Mc}]+", "")))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("h", "k", "text").rowsBetween(Window.unboundedPreceding, -1))
    picked = picked.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < sample_chars)
    found: dict[str, tuple[list[str], int]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["h"], r["k"] or "", r["text"])):
        own, size = found.get(r["lang"], ([], 0))
        found[r["lang"]] = ([*own, r["text"]], size + r["size"])
    return found


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """The samples: bounded text per language. Rows without text or label are left out by this function.

    One pass counts the rows with a letter per language and their characters; a second takes as many of them per language,
    those of smallest hashed key, as should fill the sample (``SAMPLE_DOCS`` at least). Where they turn out not to, as few
    long texts hide among short ones, eight times as many are taken, until the sample is full or no row is left. What
    reaches the driver is bounded by languages and ``sample_chars``, but for the last text of each.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    most = 4 * sample_chars  # a text longer than the sample can't add more than the sample holds
    sizes = rows.groupBy(lang).agg(F.count(F.lit(1)), F.sum(F.least(F.length(text), F.lit(most)))).collect()
    counts = {r[0]: r[1] for r in sizes}
    wanted = {r[0]: min(r[1], max(SAMPLE_DOCS, math.ceil(2 * sample_chars * r[1] / r[2]))) for r in sizes}
    texts: dict[str, list[str]] = {}
    while wanted:
        found = _drawn(rows, {name: w / counts[name] for name, w in wanted.items()}, sample_chars, key, text, lang)
        texts |= {name: own for name, (own, _) in found.items()}
        short = [name for name, w in wanted.items() if w < counts[name] and found.get(name, ([], 0))[1] < sample_chars]
        wanted = {name: min(counts[name], 8 * wanted[name]) for name in short}
    whole = {name: "".join(map(chr, normalised(["\n".join(own)])[0].tolist())) for name, own in texts.items()}
    return {name: t[:sample_chars] for name, t in whole.items() if t.strip()}


def predict(docs: DataFrame, samples: dict[str, str], text: str = "text", pred: str = "lang_pred", score: str = "score", keep_text: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (share of phrases saved against the second language). Row-wise: no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    rows = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit(""))).drop(pred, score)
    if not keep_text:
        rows = rows.drop(text)
    kept = [c for c in rows.columns if c != "__text"]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(pred, T.StringType(), False), T.StructField(score, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(shared.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                names, scores = own.predict(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, pred, score])

    return rows.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from: those with crc32(key as text) mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep_text: bool = False) -> DataFrame:
    """Learn from the labelled rows that aren't held out, and predict every row."""
    samples = learn(docs.filter(~held_out(key)), key, text, lang)
    return predict(docs, samples, text, keep_text=keep_text)
