"""Toxicity by a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel of two words adds up their common subsequences of three characters (word ends count as
characters) within ``SPAN``, each discounted by the stretch it spans in either word, so inserted, dropped,
replaced and repeated characters cost little. The kernel of two sentences adds up a power of their
words' kernels. A sentence is a window of ``WINDOW`` words of a text; beside the words themselves it holds
them without digits for letters or a character put between all others, and short neighbours joined, so that gaps of
white space cost nothing. The machine is fitted on labelled texts: a text counts by its worst window, and
within a window by the distinct words that count against it, both found anew in every round (a latent
support vector machine). Words with a kernel below ``NEAR`` to every toxic landmark count as nothing,
and a lower bound of a word's kernel with itself tells most of these after one table look-up a triple.

The model is fitted on the driver from a bounded sample: ``SAMPLE`` labelled documents a class, the
first by hash, of at most ``SAMPLE_BYTES`` each; landmarks are chosen among ``WITNESSES`` words of toxic
texts and ``RIVALS`` of clean ones. Everything else works on all rows and whole texts.

Cases with a defined result: null and empty texts are scored as texts without units; labels that are
null, or of unknown documents, are ignored; if one class has no labelled row, every score is 0; repeated
rows are scored alike; an empty table gives an empty result; further columns pass through untouched, whatever their
names, but a column that has the name of the score is refused.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_path, refuse_names, write_table

SAMPLE, SAMPLE_BYTES = 3000, 24_000
TOXIC_LANDMARKS, CLEAN_LANDMARKS, LONGEST = 48, 32, 14
WITNESSES, RIVALS = 3000, 6000
DECAY, SPAN, NEAR, REJECT = 0.7, 7, 0.42, 0.7
#: Groups of toxic landmarks for which the bound that sifts words is taken at once.
GROUPS = 12
#: Words in a window, and the power of the words' kernels that a sentence's adds up.
WINDOW, POWER = 128, 1.5
#: Decimal orders by which chance must fail to explain a character run of the toxic texts.
EVIDENCE = 7.0
RIDGE, ROUNDS = 0.3, 8
#: Weight of a made sentence against a labelled one.
DISGUISED = 0.3
#: Parts of the clean and of the toxic sample that may lie on the wrong side of the tails' bounds.
CLEAN_TAIL, TOXIC_TAIL = 0.01, 0.05
#: A landmark with no clean word above this kernel tells by itself.
ALIKE = 0.8
_UNIT, _CACHE, _TEXTS = 28, 400_000, 200
_PUNCTUATION = re.compile(r"[^\w\s]+|_+")
_LEET = str.maketrans("013457", "oieast")
_SPACED = re.compile(r"(?<!\S)\w(?:\s+\w)+(?!\S)")
#: The first 256 characters in lower case, and those of them that are neither letters, digits nor white space.
_LOWER = bytes(ord(chr(c).lower()) for c in range(256))
_DROPPED = bytes(c for c in range(256) if not (chr(c).isalnum() or chr(c).isspace()))


def _lengths(words: list[str]) -> np.ndarray:
    return np.fromiter(map(len, words), np.int64, len(words))


def _measured(text: str | None) -> tuple[list[str], np.ndarray]:
    """``word_list`` and the words' lengths."""
    t = text or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    try:
        t = t.encode("latin-1").translate(_LOWER, _DROPPED).decode("latin-1")
    except UnicodeEncodeError:
        t = _PUNCTUATION.sub("", t.lower())
    words = t.split()
    lengths = _lengths(words)
    single = lengths == 1
    if (single[1:] & single[:-1]).any():
        words = _SPACED.sub(lambda m: "".join(m[0].split()), t).split()
        lengths = _lengths(words)
    return words, lengths


def word_list(text: str | None) -> list[str]:
    """The words in order, lower-cased, without punctuation, spaced-out letters joined."""
    return _measured(text)[0]


def _joints(words: list[str], lengths: np.ndarray) -> dict[int, str]:
    """The places in which ``joined`` isn't empty, with what it holds there."""
    a, b = lengths[:-1], lengths[1:]
    return {i: words[i] + words[i + 1] for i in np.flatnonzero((a < 4) & (b < 4) & (a + b > 3)).tolist()}


def joined(words: list[str]) -> list[str]:
    """For every word but the last, it and the next one as one word if both are fragments, else nothing."""
    found = _joints(words, _lengths(words))
    return [found.get(i, "") for i in range(len(words) - 1)]


def forms(word: str) -> list[str]:
    """The units a word stands for: itself (in pieces of ``_UNIT`` characters if longer), with letters for
    digits, and without a character that is put between all others."""
    if len(word) < 2:
        return []
    out = [word] if len(word) <= _UNIT else [word[i : i + _UNIT] for i in range(0, len(word) - _UNIT // 2, _UNIT // 2)]
    if not word.isalpha() and any(c in word for c in "013457") and any(c.isalpha() for c in word):
        out += forms(word.translate(_LEET))
    if 4 < len(word) <= 2 * _UNIT and len(set(word[1::2])) == 1:
        out += forms(word[::2])
    return out


_triples: dict[int, tuple[np.ndarray, ...]] = {}


def _places(n: int) -> tuple[np.ndarray, ...]:
    """All i < j < k below n with k - i < SPAN, and each triple's discount by the stretch it spans."""
    if n not in _triples:
        x = np.arange(n)
        i, j, k = np.nonzero((x[:, None, None] < x[None, :, None]) & (x[None, :, None] < x[None, None, :]) & (x[None, None, :] - x[:, None, None] < SPAN))
        _triples[n] = (i, j, k, (DECAY ** (k - i + 1.0)).astype(np.float32))
    return _triples[n]


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length, their ends marked, as rows of code points."""
    return np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    """The places of the words of each length, ends included, in order of first appearance."""
    found, first, count = np.unique(lengths := _lengths(words), return_index=True, return_counts=True)
    places = np.split(np.argsort(lengths, kind="stable"), np.cumsum(count)[:-1])
    return {int(found[x]) + 2: places[x] for x in np.argsort(first) if found[x] > 0}


def _own(words: list[str]) -> np.ndarray:
    """Each word's kernel with itself."""
    out = np.zeros(len(words))
    for n, at in _by_length(words).items():
        i, j, k, value = _places(n)
        for part in np.array_split(at, max(1, len(at) * len(i) // 1_000_000)):
            c = _codes([words[x] for x in part])
            _, local = np.unique(c, return_inverse=True)
            local = local.reshape(c.shape).astype(np.int64)
            size = int(local.max()) + 1
            code = (local[:, i] * size + local[:, j]) * size + local[:, k]
            code += np.arange(len(part))[:, None] * size**3
            _, which = np.unique(code, return_inverse=True)
            sums = np.bincount(which.ravel(), np.broadcast_to(value, code.shape).ravel())
            owner = np.empty(len(sums), np.int64)
            owner[which.ravel()] = np.repeat(np.arange(len(part)), len(i))
            out[part] = np.bincount(owner, sums**2, len(part))
    return out


class Features:
    """The landmarks' subsequences of three characters, with their weights by landmark (normalised)."""

    def __init__(self, marks: list[str]) -> None:
        letters = sorted(set("".join(marks)) | set("^$"))
        self.letters = np.array([ord(x) for x in letters], np.uint32)
        self.base = len(letters) + 1
        index: dict[int, int] = {}
        cells = []
        for col, (m, own) in enumerate(zip(marks, _own(marks))):
            m = f"^{m}$"
            for i, j, k, v in zip(*_places(len(m))):
                code = 0
                for x in (m[i], m[j], m[k]):
                    code = code * self.base + letters.index(x) + 1
                cells.append((index.setdefault(code, len(index) + 1), col, v / np.sqrt(own)))
        self.at = np.zeros(self.base**3, np.int16 if len(index) < 32000 else np.int32)
        self.at[list(index)] = list(index.values())
        self.table = np.zeros((len(index) + 1, len(marks)), np.float32)
        for row, col, v in cells:
            self.table[row, col] += v
        self.tops: dict[int, np.ndarray] = {}

    def _tops(self, near: int) -> np.ndarray:
        """The first ``near`` landmarks in ``GROUPS`` groups of like ones: each feature's greatest weight in each group."""
        if near not in self.tops:
            t = self.table[:, :near]
            like = t.T @ t
            seeds = [0]
            while len(seeds) < min(GROUPS, near):
                seeds.append(int(np.argmin(like[seeds].max(axis=0))))
            group = like[seeds].argmax(axis=0)
            self.tops[near] = np.stack([t[:, group == g].max(axis=1, initial=0) for g in range(len(seeds))], axis=1)
        return self.tops[near]

    def _bound(self, one: np.ndarray, near: int) -> np.ndarray:
        """For words of one length, as rows of letter numbers: what their kernel to none of the first ``near`` landmarks exceeds."""
        n, tops = one.shape[1], self._tops(near)
        one = np.ascontiguousarray(one.T)
        two = one * np.int32(self.base)
        three = two * np.int32(self.base)
        out = np.zeros((one.shape[1], tops.shape[1]), np.float32)
        for both in range(2, min(SPAN, n)):
            ends = three[: n - both] + one[both:]
            for first in range(1, both):
                f = self.at.take(ends + two[first : first + n - both])
                out += tops.take(f, axis=0).sum(axis=0) * np.float32(DECAY ** (both + 1))
        return out.max(axis=1, initial=0)

    def raw(self, codes: np.ndarray, near: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of words of one length that may have a kernel of ``least`` to one of the first ``near``
        landmarks (all rows for 0), and their kernel values, normalised by the landmarks alone."""
        n = codes.shape[1]
        local = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        one = np.where(self.letters[local] == codes, local + 1, 0).astype(np.int32)
        kept = np.arange(len(codes))
        if near:
            kept = np.flatnonzero(self._bound(one, near) >= least * 0.9999)
            one = one[kept]
        two = one * np.int32(self.base)
        three = two * np.int32(self.base)
        rows, features, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        for first in range(1, min(SPAN - 1, n - 1)):
            begun = three[:, : n - first] + two[:, first:]
            for both in range(first + 1, min(SPAN, n)):
                f = self.at.take(begun[:, : n - both] + one[:, both:]).ravel()
                hit = np.flatnonzero(f)
                rows.append(hit // (n - both))
                features.append(f[hit])
                values.append(np.full(len(hit), DECAY ** (both + 1), np.float32))
        row, feature, value = map(np.concatenate, (rows, features, values))
        out = np.zeros((len(kept), self.table.shape[1]), np.float32)
        if len(row):
            order = np.argsort(row, kind="stable")
            row = row[order]
            held = self.table[feature[order]] * value[order][:, None]
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            out[row[first]] = np.add.reduceat(held, first, axis=0)
        return kept, out

    def kernel(self, words: list[str], near: int = 0, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words with a kernel of at least ``least`` to one of the first ``near`` landmarks
        (all words for 0), and their normalised kernel values. No word's kernel with itself is below the
        sum of its squared discounts, which rules out most words before that kernel is computed."""
        rows, values = [np.empty(0, np.int64)], [np.empty((0, self.table.shape[1]), np.float32)]
        for n, at in _by_length(words).items():
            value = _places(n)[3]
            floor = np.sqrt((value.astype(float) ** 2).sum())
            for part in np.array_split(at, max(1, len(at) * n // 100_000)):
                kept, raw = self.raw(_codes([words[x] for x in part]), near, least * floor)
                part = part[kept]
                if near:
                    may = raw[:, :near].max(axis=1, initial=0) >= least * floor * 0.9999
                    part, raw = part[may], raw[may]
                if not len(part):
                    continue
                full = raw / np.sqrt(_own([words[x] for x in part]))[:, None].astype(np.float32)
                if near:
                    ok = full[:, :near].max(axis=1) >= least
                    part, full = part[ok], full[ok]
                rows.append(part)
                values.append(full)
        return np.concatenate(rows), np.concatenate(values)


def kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernel values, words x landmarks, in 0..1."""
    out = np.zeros((len(words), len(marks)), np.float32)
    rows, values = Features(marks).kernel(words)
    out[rows] = values
    return out


class Model:
    """Landmarks with weights; ``worth`` is what a word adds to a window's margin, ``margin`` a text's
    greatest one, ``probability`` its calibrated value."""

    def __init__(self, toxic: list[str], clean: list[str]) -> None:
        self.toxic, self.marks = toxic, toxic + clean
        self.beta, self.bias = np.zeros(len(self.marks), np.float32), 0.0
        self.slope, self.middle = 1.0, 0.0
        self.features = Features(self.marks) if toxic else None

    def worth(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.float32)
        if self.toxic:
            owner, units = _owned(words)
            rows, k = self.features.kernel(units, len(self.toxic), NEAR)
            np.maximum.at(out, owner[rows], np.maximum(k**POWER @ self.beta, 0))
        return out

    def margin(self, words: list[str], joints: dict[int, str], worth: dict[str, float]) -> float:
        """The greatest window's margin, from the words, their joined neighbours and what each is worth, if anything."""
        hits = [(i, w) for i, w in enumerate(words) if w in worth]
        hits = sorted(hits + [(i, w) for i, w in joints.items() if w in worth])
        return self.bias + best_window([i for i, _ in hits], [w for _, w in hits], worth)[0]

    def probability(self, margin: np.ndarray) -> np.ndarray:
        if not self.toxic:
            return np.zeros(len(margin))
        return 1 / (1 + np.exp(-self.slope * (np.asarray(margin, float) - self.middle)))


def _owned(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """The words' units, and for each the place of its word."""
    made = [[w] if w.isalpha() and 1 < len(w) <= _UNIT and (len(w) < 5 or w[1] != w[3]) else forms(w) for w in words]
    return np.repeat(np.arange(len(words)), [len(m) for m in made]), [u for m in made for u in m]


def best_window(at: list[int], what: list, worth) -> tuple[float, tuple[int, int]]:
    """The greatest sum of what the distinct words of one window are worth, and the window as a range of hits."""
    held: Counter = Counter()
    best, span, now, first = 0.0, (0, 0), 0.0, 0
    for j, (i, w) in enumerate(zip(at, what)):
        while i - at[first] >= WINDOW:
            held[what[first]] -= 1
            if not held[what[first]]:
                now -= worth[what[first]]
            first += 1
        if not held[w]:
            now += worth[w]
        held[w] += 1
        if now > best + 1e-9:
            best, span = now, (first, j + 1)
    return best, span


def _spread(words: list[str], weight: np.ndarray, most: int) -> list[str]:
    """Landmarks far from each other, heavier words first."""
    chosen: list[str] = []
    far = np.ones(len(words))
    while len(chosen) < min(most, len(words)):
        i = int(np.argmax(far * weight))
        if far[i] * weight[i] <= 1e-6:
            break
        chosen.append(words[i])
        far = np.minimum(far, 1 - kernel(words, [words[i]])[:, 0])
    return chosen


def _apart(bags: list[np.ndarray], words: list[str]) -> list[int]:
    """The place of one text of each group of near copies (words alike by 0.8, found by bands of four least
    hashes), so that a much-copied text counts as the one witness that it is. Bags are sorted word numbers."""
    raw = [w.encode() for w in words]
    hashes = np.array([[zlib.crc32(w, s) for w in raw] for s in range(16)], np.uint32) if raw else np.zeros((16, 0), np.uint32)
    seen: dict[tuple, int] = {}
    kept = []
    for i, b in enumerate(bags):
        least = hashes[:, b].min(axis=1).tolist() if len(b) else [None] * 16
        bands = [(k, *least[4 * k : 4 * k + 4]) for k in range(4)]
        for j in {seen[x] for x in bands if x in seen}:
            both = len(np.intersect1d(b, bags[j], assume_unique=True))
            if both >= 0.8 * (len(b) + len(bags[j]) - both):
                break
        else:
            kept.append(i)
            seen.update((x, i) for x in bands)
    return kept


def _variants(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a character inserted, dropped, doubled or replaced."""
    out = []
    for kind in range(4):
        i = int(rng.integers(1, max(2, len(word) - 1)))
        c = "xqz0134"[int(rng.integers(7))]
        out.append((word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:] if i < len(word) else word, word[:i] + c + word[i + 1 :])[kind])
    return [w for w in out if len(w) >= 4 or len(word) == 3]


def _grams(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i : i + n] for n in (4, 5, 6) for i in range(len(w) - n + 1)}


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps over the active rows."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    reg = np.eye(x.shape[1]) * ridge
    reg[-1, -1] = 1e-6
    for _ in range(60):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        new = np.linalg.solve(a.T @ x[on] + reg, a.T @ y[on])
        done = np.abs(new - w).max() < 1e-7
        w = w + (new - w) * (1.0 if _ < 20 else 0.5)
        if done:
            break
    return w[:-1], float(w[-1])


def _strong_words(words: list[str], in_toxic: np.ndarray, in_clean: np.ndarray, n_toxic: int, n_clean: int) -> Counter:
    """Words of toxic texts with a character run that chance would hardly put there alone, and in how many texts they are."""
    share = np.log10((n_toxic + n_clean) / n_toxic)
    need = max(3, int(EVIDENCE / share))
    # Runs are counted in two passes, the first by hash alone: only those that may be frequent get entries.
    rough = np.zeros(1 << 22, np.int64)
    for i in np.flatnonzero(in_toxic):
        for g in _grams(words[i]):
            rough[zlib.crc32(g.encode()) & 0x3FFFFF] += in_toxic[i]
    of_t: Counter = Counter()
    for i in np.flatnonzero(in_toxic):
        for g in _grams(words[i]):
            if rough[zlib.crc32(g.encode()) & 0x3FFFFF] >= need:
                of_t[g] += int(in_toxic[i])
    of_t = Counter({g: n for g, n in of_t.items() if n >= need})
    del rough
    of_c: Counter = Counter()
    for i in np.flatnonzero(in_clean):
        for g in _grams(words[i]):
            if g in of_t:
                of_c[g] += int(in_clean[i])

    def strong(g: str) -> bool:
        """Log odds of a character run, if chance would hardly put it into toxic texts alone."""
        t, c = of_t[g], of_c[g]
        odds = np.log((t + 0.5) / n_toxic) - np.log((c + 0.5) / n_clean)
        return odds > 3 and t * share - c * 3 >= EVIDENCE

    good = {g for g in of_t if strong(g)}
    found = (i for i in np.flatnonzero(in_toxic) if in_clean[i] * n_toxic < 0.05 * in_toxic[i] * n_clean)
    return Counter({words[i]: int(in_toxic[i]) for i in found if not good.isdisjoint(_grams(words[i]))})


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Learn from labelled texts (1: toxic)."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    orders = []
    for t in texts:
        words = word_list(t)
        pairs = joined(words)
        both = [number.setdefault(w, len(number)) for w in words]
        orders.append((np.array(both, np.int32), np.array([number.setdefault(w, len(number)) if w else -1 for w in pairs], np.int32)))
    words = list(number)
    del number
    bags = [np.unique(np.concatenate([a, b[b >= 0]])) for a, b in orders]
    kept = _apart(bags, words)
    bags, orders, labels = [bags[i] for i in kept], [orders[i] for i in kept], [labels[i] for i in kept]
    is_toxic = np.array(labels) == 1
    if is_toxic.all() or not is_toxic.any():
        return Model([], [])
    in_toxic, in_clean = (np.bincount(np.concatenate([b for b, y in zip(bags, is_toxic) if y == z]), minlength=len(words)) for z in (True, False))
    witness = _strong_words(words, in_toxic, in_clean, int(is_toxic.sum()), int((~is_toxic).sum()))
    if not witness:
        return Model([], [])
    found = sorted(witness, key=lambda w: (-witness[w], w))[:WITNESSES]
    short = [w for w in found if len(w) <= LONGEST]
    toxic = _spread(short, np.log1p([witness[w] for w in short]), TOXIC_LANDMARKS)
    # What no window of the sample holds near a landmark adds nothing: only these words are kept.
    owner, units = _owned(words)
    rows, near = Features(toxic).kernel(units, len(toxic), NEAR)
    near_of = np.zeros(len(words), np.float32)
    np.maximum.at(near_of, owner[rows], near.max(axis=1, initial=0))
    clear_marks = near[in_clean[owner[rows]] > 0].max(axis=0, initial=0) < ALIKE
    telling = np.zeros(len(words), bool)
    np.logical_or.at(telling, owner[rows], clear_marks[near.argmax(axis=1)])
    rivals = np.flatnonzero((near_of > 0) & (in_clean > 0))
    rivals = rivals[np.lexsort((rivals, -(near_of[rivals] * np.log1p(in_clean[rivals]))))][:RIVALS]
    clean = _spread([words[i] for i in rivals if 2 < len(words[i]) <= LONGEST][:600], np.log1p([in_clean[i] for i in rivals if 2 < len(words[i]) <= LONGEST][:600]), CLEAN_LANDMARKS)
    model = Model(toxic, clean)
    values, vectors = np.linalg.eigh(kernel(model.marks, model.marks).astype(float) ** POWER)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    kept = np.flatnonzero(near_of > 0)
    place = np.full(len(words) + 1, -1)
    place[kept] = np.arange(len(kept))
    hits, y, weight = [], [], []
    made: dict[str, int] = {}
    spoiled: dict[int, list[int]] = {}

    def disguise(w: int) -> int:
        if w not in spoiled:
            spoiled[w] = [len(kept) + made.setdefault(v, len(made)) for v in _variants(words[kept[w]], rng)]
        return spoiled[w][int(rng.integers(len(spoiled[w])))] if spoiled[w] else w

    for (a, b), label in zip(orders, labels):
        at = np.concatenate([np.arange(len(a)), np.arange(len(b))])
        what = place[np.concatenate([a, b])]
        order = np.lexsort((np.arange(len(at)), at))
        order = order[what[order] >= 0]
        at, what = at[order].tolist(), what[order].tolist()
        hits.append((at, what))
        y.append(1.0 if label == 1 else -1.0)
        weight.append(1.0)
        told = [(i, w) for i, w in zip(at, what) if words[kept[w]] in witness] if label == 1 else []
        if told:
            # The same text with its witnesses disguised; one witness alone, plain and disguised, if no clean word is like it.
            disguised = {w: disguise(w) for _, w in told}
            more = [(at, [disguised.get(w, w) for w in what])]
            clear = sorted(w for w in disguised if telling[kept[w]])
            if clear:
                alone = clear[int(rng.integers(len(clear)))]
                more += [([0], [alone]), ([0], [disguised[alone]])]
            hits += more
            y += [1.0] * len(more)
            weight += [DISGUISED] * len(more)
    y, weight = np.array(y), np.array(weight)
    balance = np.where(y > 0, max(1.0, (weight[y < 0].sum() / weight[y > 0].sum()) ** 0.5), 1.0)
    named = [words[i] for i in kept] + list(made)
    owner, units = _owned(named)
    rows, k = model.features.kernel(units, len(toxic), NEAR)
    k = k.astype(float) ** POWER @ root
    w, worth, least = np.zeros(len(model.marks)), np.zeros(len(named)), np.inf
    np.maximum.at(worth, owner[rows], 1.0)
    margin = np.ones(len(rows))
    for _ in range(ROUNDS):
        best = np.full(len(named), -1)
        order = np.argsort(margin, kind="stable")
        order = order[margin[order] > 0]
        best[owner[rows[order]]] = order
        x = np.zeros((len(hits), len(model.marks)))
        for i, (at, what) in enumerate(hits):
            if at:
                _, (lo, hi) = best_window(at, what, worth)
                x[i] = k[[best[v] for v in sorted(set(what[lo:hi])) if best[v] >= 0]].sum(axis=0)
        new, bias = _machine(x, y, weight * balance)
        margin = k @ new
        worth = np.zeros(len(named))
        np.maximum.at(worth, owner[rows], np.maximum(margin, 0))
        top = np.array([bias + best_window(at, what, worth)[0] for at, what in hits], float)
        loss = float((weight * balance * np.maximum(0, 1 - y * top) ** 2).sum() + RIDGE * new @ new)
        if loss < least * (1 - 1e-4):
            least, w, model.bias, tops = loss, new, bias, top
        elif loss > least:
            break
    model.beta = (root @ w).astype(np.float32)
    plain = weight != DISGUISED
    model.slope, _ = _platt(tops[plain], (y[plain] > 0).astype(float))
    # A score of REJECT lies above the clean tail, by a quarter of the way to the toxic one.
    bound, other = np.quantile(tops[plain & (y < 0)], 1 - CLEAN_TAIL), np.quantile(tops[plain & (y > 0)], TOXIC_TAIL)
    reject = bound + max(0.0, other - bound) / 4
    model.middle = float(reject - np.log(REJECT / (1 - REJECT)) / model.slope)
    return model


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on margins, its targets drawn in by one row a class."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * neg))
    a = np.stack([x, np.ones(len(x))], axis=1)
    c = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-3
        step = np.linalg.solve(h, a.T @ (w * (t - p)) - 1e-3 * c)
        c += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(c[0], 1e-3)
    return float(slope), float(-c[1] / slope)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """At most ``sample`` texts of each class, first by hash, from ids whose crc32 mod 3 is not 1.

    Ids are chosen first and texts fetched after: no task gathers more than its part of 4 x ``sample`` texts."""
    known = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    order = F.xxhash64("doc_id")
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("toxic") == y).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(y).alias("y")).orderBy(order, "doc_id").limit(2 * sample)
        chosen = some if chosen is None else chosen.union(some)
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y"))
    # At most 4 x sample rows of 12 bytes are broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= most_bytes).join(F.broadcast(chosen), "doc_id")
    held, path = write_table(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled")
    first = [held.where(F.col("y") == y).select("doc_id").orderBy(order, "doc_id").limit(sample) for y in (0, 1)]
    ids = first[0].union(first[1])
    picked = held.join(F.broadcast(ids), "doc_id", "left_semi").collect()  # at most 2 x sample texts of most_bytes
    drop_path(docs.sparkSession, path)
    picked.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in picked], [r.y for r in picked]


_known: dict[bytes, tuple[set[str], dict[str, float]]] = {}


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    """Each text's probability; words already seen that are worth nothing, and what the others are worth, come
    from a cache of bounded size."""
    key = model.beta.tobytes()
    if key not in _known:
        _known.clear()
        _known[key] = set(), {}
    idle, worth = _known[key]
    margins = np.full(len(texts), model.bias)
    for i in range(0, len(texts), _TEXTS):
        lists, joints, bags = [], [], []
        for t in texts[i : i + _TEXTS]:
            words, lengths = _measured(t)
            lists.append(words)
            joints.append(_joints(words, lengths))
            bags.append(set(words).union(joints[-1].values()))
        words = set().union(*bags)
        fresh = words.difference(idle).difference(worth)
        if len(fresh) + len(idle) + len(worth) > _CACHE:
            idle.clear()
            worth.clear()
            fresh = words
        fresh = list(fresh)
        for j in range(0, len(fresh), 50_000):
            part = fresh[j : j + 50_000]
            value = model.worth(part)
            idle.update(part)
            found = {part[x]: float(value[x]) for x in np.flatnonzero(value > 0)}
            idle.difference_update(found)
            worth.update(found)
        for k, bag in enumerate(bags):
            if worth.keys() & bag:
                margins[i + k] = model.margin(lists[k], joints[k], worth)
    return model.probability(margins)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """The rows with all their columns and one more: the text's probability of being toxic."""
    bound_batches(docs.sparkSession)
    refuse_names(docs, name)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = score_texts(b.column(at).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name)).schema)


def toxicity(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, by a model fitted on its labelled rows."""
    model = fit(*labelled_sample(docs, labels))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, name="score")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))
