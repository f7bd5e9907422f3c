"""Toxicity by noisy-channel deobfuscation.

What a reader sees through is undone first: signs that stand for letters, letters repeated, spaced
or cut by points. Every suspicious token, and every stretch of text in short pieces, is a lattice of the letters that each
sign may stand for and of where words end; the path that is likeliest under a character trigram model, less the
channel's costs, is the restored words (Viterbi).
Restored words are then looked up, whole and by their beginnings, in a lexicon of what tells
toxic labelled documents from others, and a logistic calibration turns a document's evidence into a probability.
Lexicon, character model and calibration are learnt from every labelled document: tasks count words, beginnings and
the calibration's sums, and only what the model keeps comes to the driver.

Defined results: null text is empty; an empty text has no evidence and gets the calibrated score of that. Equal
texts get equal scores. With fewer than four labelled documents of either label every score is the smoothed share of label 1 among those.
Repeated rows do not matter, nor do extra columns but those named like the result's; an id that stands on rows of several texts teaches with each. Of
tokens that are decoded the runs of letters are looked up too.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, release, ship
from .quality import newton, slopes

#: Labels that are sent to every task to find their documents; beyond it both are shuffled.
SENT_LABELS = 500_000
#: Words and beginnings that a task counts before it hands them on, and tokens whose words it keeps meanwhile.
COUNTED, SPLIT = 100_000, 100_000
#: Bits of a text's hash of which the one that halves both classes best deals the documents.
BITS = 16
#: Weights of words are whole numbers in this unit, so that sums don't depend on their order.
UNIT = 2.0**-20
#: The letters that a sign may stand for.
LETTERS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
#: Signs that may hide any letter, and signs that may stand between letters.
WILD, BETWEEN = "*#", ".-_~'·/\\:,*#%&^=\"`"
#: Costs (negative logarithms of probabilities) of what the channel does: to write a sign for a letter,
#: to hide a letter, to put a sign in between, to repeat a letter.
SIGN, HIDE, PUT, REPEAT = 1.0, 2.0, 0.7, 0.4
#: To space two letters of a word, and to do so by more than the narrowest space of the stretch.
GAP, WIDE = 0.7, 2.1
#: Of what is decoded by matrices (beyond it the result is the same, but slower), and how much a task keeps of it.
DENSE_LETTERS, DENSE_SIGNS, KEPT_TAILS, KEPT_COSTS, KEPT_SPOKEN, KEPT_RESTORED = 90, 1000, 100, 100_000, 20_000, 50_000
#: Of the calibration's coefficients, on features of like scale.
PENALTY = 0.3
#: Beginnings of words that the lexicon has, in letters.
STEMS = range(4, 8)
#: The weight from which a word alone tells much.
STRONG = 4.0
#: A feature is learnt if it has this many toxic documents, this log ratio and this log-likelihood statistic. With few
#: toxic documents the statistic need only be FEW_STATISTIC, or the share PART of what a word in all of them would have.
LEAST_DOCS, LEAST_WEIGHT, LEAST_STATISTIC, FEW_STATISTIC, PART = 3, 2.5, 24.0, 10.0, 0.3
#: Tokens whose evidence a task keeps at hand.
KEPT_TOKENS = 250_000
EDGE = ".,;:!?\"'()[]{}<>%&#*|~`^=/\\-_+$@"
STOPS = ".,;:?\"'()"
#: Signs around a piece that are no part of it.
BETWEEN_ONLY = "".join(c for c in EDGE + BETWEEN if c not in LETTERS and c not in WILD)
#: Signs that may be letters.
HIDING = frozenset(LETTERS) | frozenset(WILD)
_run, _double = re.compile(r"(.)\1\1"), re.compile(r"(.)\1+")
_letters = re.compile(r"[^\W\d_]+")
#: Three or more single signs with one or two spaces, points or the like between them.
_spaced = re.compile(r"(?<!\S)\w(?:[ ._\-*]{1,2}\w){2,}(?!\S)")
_around, _inner = f"[{re.escape(BETWEEN_ONLY)}]*+", rf"[^\s{re.escape(BETWEEN_ONLY)}]{{0,2}}+"
_piece = rf"(?=\S){_around}{_inner}{_around}(?!\S)"
_stretch = re.compile(rf"(?<!\S){_piece}(?:\s++{_piece}){{2,}}")
#: The same two in a text with a space before it: a search for white space is much faster than one for what is not behind a sign.
_spaced_after = re.compile(r"\s(?=\w[ ._\-*])(\w(?:[ ._\-*]{1,2}\w){2,})(?!\S)")
_stretch_after = re.compile(rf"\s(?![a-z]{{3}})({_piece}(?:\s++{_piece}){{2,}})")
_gap, _gap_or_sign = re.compile(r"\s+"), re.compile(r"\s+|\S")


@dataclass
class CharacterModel:
    """Trigrams of letters in words; ^ and $ are their ends."""

    counts: dict[str, Counter] = field(default_factory=dict)
    letters: str = ""

    @staticmethod
    def of(words: Iterable[tuple[str, float]], grams: Iterable[tuple[str, float, int]] = ()) -> CharacterModel:
        """Of words and their weights, and of three-letter pieces that were counted before: with weight, and in how many words."""
        counts: dict[str, Counter] = defaultdict(Counter)
        letters = Counter()
        for gram, weight, n in grams:
            counts[gram[:2]][gram[2]] += weight
            if gram[2] != "$":
                letters[gram[2]] += n
        for word, n in words:
            w = f"^^{word}$"
            letters.update(word)
            for i in range(2, len(w)):
                counts[w[i - 2 : i]][w[i]] += n
        return CharacterModel(dict(counts), "".join(sorted(c for c, n in letters.items() if n > 2)) or "e")

    def cost(self, before: str, letter: str) -> float:
        known = self.costs()
        found = known.get(before + letter)
        if found is None:
            seen = self.counts.get(before)
            total = self.__dict__.setdefault("_totals", {}).setdefault(before, sum((seen or {}).values()))
            found = 5.0 if seen is None else -math.log((seen.get(letter, 0) + 0.05) / (total + 0.05 * 40))
            if len(known) < KEPT_COSTS:
                known[before + letter] = found
        return found

    def costs(self) -> dict[str, float]:
        """Costs that were asked for, by the two letters before and the letter."""
        return self.__dict__.setdefault("_costs", {})

    def spoken(self, stretch: str) -> tuple[str, ...]:
        """The words of a stretch; those met last are kept."""
        known = self.__dict__.setdefault("_spoken", {})
        found = known.get(stretch)
        if found is None:
            if len(known) >= KEPT_SPOKEN:
                known.clear()
            found = known[stretch] = tuple(decode(stretch, self))
        return found

    def forget(self) -> None:
        """Drop the words and stretches that were kept."""
        for kept in ("_spoken", "_restored"):
            self.__dict__.pop(kept, None)

    def dearest(self) -> float:
        """No letter costs more."""
        if "_dearest" not in self.__dict__:
            most = max((sum(x.values()) for x in self.counts.values()), default=0.0)
            self.__dict__["_dearest"] = max(5.0, -math.log(0.05 / (most + 0.05 * 40)))
        return self.__dict__["_dearest"]


def _options(c: str, previous: str, letters: str) -> list[tuple[str, float]]:
    """What a sign of a word may say, and at what cost; "" is nothing."""
    if c.isalpha():
        return [(c, 0.0), ("", REPEAT)] if c == previous else [(c, 0.0)]
    options = [(x, SIGN) for x in LETTERS.get(c, "")]
    if c in WILD:
        options += [(x, HIDE) for x in letters]
    if c in BETWEEN or (c == previous and not c.isalnum()) or not options:
        options.append(("", PUT))
    return options


def decode(raw: str, model: CharacterModel) -> list[str]:
    """The likeliest words behind ``raw``: the least total cost over the lattice, by Viterbi over all two-letter states,
    in time linear in the length. White space is dropped or ends a word, wide space rather ends one."""
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    narrow = min((len(x) for x in _gap.findall(raw)), default=1)
    previous, costs = "", model.costs()
    for piece in _gap_or_sign.findall(raw):
        following: dict[str, tuple[float, tuple | None]] = {}
        if piece.isspace():
            price = GAP if len(piece) <= narrow else WIDE
            following["^^"] = states.get("^^", (math.inf, None))
            for before, (cost, path) in states.items():
                if before != "^^":
                    following[before] = (cost + price, path)
                    if (total := cost + model.cost(before, "$")) < following["^^"][0]:
                        following["^^"] = (total, (path, " "))
            states = following
            continue
        options = _options(piece, previous, model.letters)
        for before, (cost, path) in states.items():
            for letter, price in options:
                key = before + letter
                after, total = key[-2:], cost + price
                if letter:
                    more = costs.get(key)
                    total += model.cost(before, letter) if more is None else more
                if after not in following or total < following[after][0]:
                    following[after] = (total, (path, letter) if letter else path)
        states, previous = following, piece
    path = min(((cost + (model.cost(before, "$") if before != "^^" or not path else 0.0), path) for before, (cost, path) in states.items()), key=lambda x: x[0])[1]
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters)).split()


class Dense:
    """The same lattice for one word by matrices over all pairs of letters, for tokens with signs that hide any letter."""

    def __init__(self, model: CharacterModel):
        self.letters = model.letters
        names = "^" + model.letters
        self.at = {c: i for i, c in enumerate(names)}
        self.cost = np.array([[[model.cost(a + b, c) for c in names] for b in names] for a in names])
        self.cost[:, :, 0] = np.inf
        self.end = np.array([[model.cost(a + b, "$") for b in names] for a in names])
        self.tails: dict[str, list[np.ndarray]] = {}

    def rest(self, token: str, i: int, after: np.ndarray) -> np.ndarray:
        """Least costs from sign ``i`` on for each pair of letters before it, from those after it."""
        c, before = token[i], token[i - 1] if i else ""
        options = _options(c, before, "")
        ways = [after + price if not x else price + self.cost[:, :, j] + after[:, j] for x, price in options for j in [self.at.get(x, 0)]]
        if c in WILD:
            ways.append(HIDE + (self.cost + after).min(2))
        return np.minimum.reduce(ways)

    def restore(self, token: str) -> str:
        start = len(token)
        while start and not token[start - 1].isalnum():
            start -= 1
        tail = token[start:]
        if tail not in self.tails:
            costs = [self.end]
            for i in range(len(token) - 1, start - 1, -1):
                costs.append(self.rest(token, i, costs[-1]))
            if len(self.tails) >= KEPT_TAILS:
                self.tails.clear()
            self.tails[tail] = costs
        costs = self.tails[tail].copy()
        # letters that can only stand for themselves need no choice
        head = token[:start]
        fixed = start if head.isalpha() and not _double.search(head) else 0
        for i in range(start - 1, fixed - 1, -1):
            costs.append(self.rest(token, i, costs[-1]))
        costs.reverse()
        word = list(token[:fixed])
        a, b = ([0, 0] + [self.at[x] for x in word[-2:]])[-2:]
        for i, c in enumerate(token[fixed:], fixed):
            after = costs[i - fixed + 1]
            ways = [(after[a, b] + price if not x else price + self.cost[a, b, self.at[x]] + after[b, self.at[x]], x) for x, price in _options(c, token[i - 1] if i else "", self.letters) if not x or x in self.at]
            if x := min(ways)[1]:
                word.append(x)
                a, b = b, self.at[x]
        return "".join(word)


def restore(token: str, model: CharacterModel) -> str:
    """The likeliest word behind ``token``, which has no white space; those met last are kept, also where plain tokens crowd them out elsewhere."""
    known = model.__dict__.setdefault("_restored", {})
    found = known.get(token)
    if found is None:
        if len(known) >= KEPT_RESTORED:
            known.clear()
        found = known[token] = _restored(token, model)
    return found


def _restored(token: str, model: CharacterModel) -> str:
    if any(c in WILD for c in token):
        # more signs of a run than this are dropped by any likeliest path: to hide a letter costs more, and pays in two terms at most
        most = math.ceil(2 * model.dearest() / (HIDE - PUT)) + 1
        token = re.sub(rf"([{WILD}])\1{{{most},}}", lambda m: m.group(1) * most, token)
        if len(model.letters) <= DENSE_LETTERS and len(token) <= DENSE_SIGNS:
            dense = model.__dict__.get("_dense") or model.__dict__.setdefault("_dense", Dense(model))
            if all(not c.isalpha() or c in dense.at for c in token) and all(x in dense.at for c in token for x in LETTERS.get(c, "")):
                return dense.restore(token)
    return "".join(decode(token, model))


@dataclass
class Model:
    lexicon: dict[str, float]
    characters: CharacterModel
    coefficients: list[float]


def plain(token: str) -> str | None:
    """The word of a token that hides nothing, or None."""
    core = token if token.isalpha() else token.strip(EDGE)
    return core if (core.isalpha() or not core) and not _run.search(core) else None


def words_of(token: str, characters: CharacterModel, asked: Callable[[str], bool] = bool) -> list[str]:
    """What a token may say: its word, its word without doubled letters, or what is restored of it with
    and without signs at its ends that may be letters. Only what is ``asked`` for is restored."""
    core = plain(token)
    if core is not None:
        if not core:
            return []
        said = [core, once] if (once := _double.sub(r"\1", core)) != core else [core]
        if core == token or HIDING.isdisjoint(token):
            return said
        return said + [restore(x, characters) for x in with_ends(token) if x != core and not HIDING.isdisjoint(x) and asked(x)]
    if not any(c.isalpha() for c in token):
        return []
    runs = [x for x in _letters.findall(token) if len(x) >= STEMS.start]
    return runs + [restore(x, characters) for x in with_ends(token) if asked(x)]


def with_ends(token: str) -> set[str]:
    """A token without stops at its ends, and also with a bracket before it that may be a letter, and without exclamation marks."""
    return {token.strip(STOPS), token.rstrip(STOPS).lstrip(STOPS.replace("(", "")), token.strip(STOPS + "!")}


def keys(word: str) -> list[str]:
    return [word, *[word[:n] + "~" for n in STEMS[: max(0, len(word) - STEMS.start + 1)]]]


def stretches(low: str) -> set[str]:
    """Stretches of three or more pieces of one or two signs each, as they stand, that may be spaced words."""
    return {x for x in _stretch_after.findall(f" {low}") if any(c.isalpha() for c in x)}


def in_pieces(tokens: list[str]) -> tuple[bool, bool]:
    """Whether ``_spaced`` and ``_stretch`` may match a text of these tokens: the first takes three single signs, or a token that has a sign
    between among its first two; the second takes three tokens of two signs at most between others."""
    spaced, stretched, singles, shorts = False, False, 0, 0
    for t in tokens:
        n = len(t)
        if n > 2 and t.isalpha():
            singles = shorts = 0
            continue
        if n == 1:
            singles += 1
            shorts += 1
            spaced = spaced or singles > 2
        else:
            singles = 0
            if t[0] in "._-*" or t[1] in "._-*":
                spaced = True
            if n == 2 or len(t.strip(BETWEEN_ONLY)) < 3:
                shorts += 1
            else:
                shorts = 0
                continue
        if shorts > 2:
            stretched = True
    return spaced, stretched


def tokens_of(text: str, characters: CharacterModel | None = None) -> set[str]:
    """The tokens of a text, its spaced words joined, and with a character model also as the lattice has them."""
    low = text.lower()
    said = low.split()
    spaced, stretched = in_pieces(said)
    tokens = {*said}
    if spaced:
        tokens.update(re.sub(r"[ ._\-*]", "", x) for x in _spaced_after.findall(f" {low}"))
    if stretched and characters is not None:
        for stretch in stretches(low):
            tokens.update(characters.spoken(stretch))
    return tokens


class Evidence(dict):
    """The weight of each token under a model: the largest of what it may say."""

    def __init__(self, lexicon: dict[str, float], characters: CharacterModel, kept: int = KEPT_TOKENS):
        self.lexicon, self.characters, self.kept = lexicon, characters, kept
        self.begins = {k[: STEMS.start] for k in lexicon if k.endswith("~")}
        self.heads = {k[:n] for k in lexicon for n in range(1, STEMS.start + 1)}

    def weight(self, word: str) -> float:
        """The largest weight of a word and its beginnings."""
        if word[: STEMS.start] in self.begins:
            return max(self.lexicon.get(k, 0.0) for k in keys(word))
        return self.lexicon.get(word, 0.0)

    def may_tell(self, token: str) -> bool:
        """Whether any path through the lattice of ``token`` begins as something in the lexicon does. Of others nothing that is restored has a weight."""
        if not self.heads:
            return False
        begun, previous = {""}, ""
        for c in token:
            options, following = _options(c, previous, self.characters.letters), set()
            for before in begun:
                for letter, _ in options:
                    if (head := before + letter) in self.heads or not head:
                        if len(head) == STEMS.start:
                            return True
                        following.add(head)
            if not following:
                return False
            begun, previous = following, c
        return not begun.isdisjoint(self.lexicon)

    def __missing__(self, token: str) -> float:
        if len(self) >= self.kept:
            self.clear()
        head = token[: STEMS.start]
        if head not in self.heads and len(head) == STEMS.start and head.isalpha() and not _double.search(head) and (token.isalpha() or token.rstrip(EDGE).isalpha()):
            # all that it may say begins so
            best = 0.0
        elif token.isalpha() and not _double.search(token):
            # it says itself alone
            best = self.weight(token)
        else:
            best = max(map(self.weight, words_of(token, self.characters, self.may_tell)), default=0.0)
        self[token] = best
        return best

    def features(self, text: str | None) -> tuple[float, ...]:
        tokens = tokens_of(text or "", self.characters)
        weights = [w for w in map(self.__getitem__, tokens) if w]
        strong = sum(w >= STRONG for w in weights)
        return (max(weights, default=0.0), math.log1p(sum(weights)), math.log1p(strong), sum(weights) / math.sqrt(len(tokens) + 10), math.log1p(len(tokens)))


def learn_lexicon(toxic: Counter, others: Counter, n_toxic: int, n_others: int) -> dict[str, float]:
    """Log ratios of the documents that have a word or beginning, of those that surely tell toxic ones."""
    share, lexicon = n_toxic / (n_toxic + n_others), {}
    least = min(LEAST_STATISTIC, max(FEW_STATISTIC, PART * 2 * n_toxic * math.log(1 / share)))
    for k, n in toxic.items():
        if n >= LEAST_DOCS:
            m = others[k]
            weight = math.log((n + 0.5) / (n_toxic + 1)) - math.log((m + 0.5) / (n_others + 1))
            statistic = 2 * (n * math.log(n / ((n + m) * share)) + (m * math.log(m / ((n + m) * (1 - share))) if m else 0))
            if weight >= LEAST_WEIGHT and statistic >= least:
                lexicon[k] = weight
    return lexicon


def taught(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic and crc of every labelled document, written once. Labels without a document teach nothing."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    known = F.broadcast(known) if known.count() <= SENT_LABELS else known.hint("shuffle_hash")
    rows = documents.where("text is not null").select("doc_id", "text").join(known, "doc_id")
    return materialise(rows.select("text", "toxic", F.crc32(F.col("text").cast("binary")).alias("crc")))


def _counts(rows: DataFrame, of: type, *about) -> DataFrame:
    """key, place (twice toxic and half) and in how many documents a task met it, from an ``of(*about)`` that gives a text's keys. A
    task hands on what it counted when it has counted many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of, found = of(*about), [Counter() for _ in range(4)]

        def handed_on() -> Iterator[pa.RecordBatch]:
            for place, counter in enumerate(found):
                if counter:
                    yield pa.RecordBatch.from_pydict({"key": list(counter), "place": pa.array([place] * len(counter), pa.int32()), "n": pa.array(counter.values(), pa.int64())})
                    counter.clear()

        for b in batches:
            for text, place in zip(b.column("text"), b.column("place").to_numpy(), strict=True):
                found[place].update(keys_of(text.as_py()))
                if sum(map(len, found)) >= COUNTED:
                    yield from handed_on()
        yield from handed_on()
        give_back()

    return rows.select("text", "place").mapInArrow(count, "key string, place int, n long")


class PlainWords(dict):
    """The words of a text's tokens that hide nothing; tokens met before are kept."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= SPLIT:
            self.clear()
        self[token] = found = (core,) if (core := plain(token)) else ()
        return found

    def __call__(self, text: str) -> set[str]:
        return set().union(*map(self.__getitem__, tokens_of(text)))


class Keys(dict):
    """The words and their beginnings of a text's tokens, spaced words as a character model has them."""

    def __init__(self, characters: CharacterModel):
        self.characters = characters

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= SPLIT:
            self.clear()
        core = plain(token)
        self[token] = found = (self.get(core) or tuple(keys(core))) if core else ()
        return found

    def __call__(self, text: str) -> set[str]:
        return set().union(*map(self.__getitem__, tokens_of(text, self.characters)))


def learn_grams(rows: DataFrame) -> list[tuple[str, float, int]]:
    """Three-letter pieces of all plain words, with the weight of their words (by the documents that have these) and how many
    words have them: as many as the writing has, not as there are words."""
    words = _counts(rows, PlainWords).groupBy("key").agg(F.sum("n").alias("n"))
    edged = words.select(F.concat(F.lit("^^"), "key", F.lit("$")).alias("w"), F.round(F.log1p("n") / UNIT).cast("long").alias("weight"))
    cut = edged.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))).alias("gram"), "weight")
    return [(r["gram"], r["weight"] * UNIT, r["n"]) for r in cut.groupBy("gram").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect()]


def learn_counts(rows: DataFrame, spaced: CharacterModel, sizes: list[int]) -> list[Counter]:
    """In how many documents of each place the words and beginnings stand that may enter a lexicon of either half or of both."""
    at = [F.sum(F.when(F.col("place") == p, F.col("n")).otherwise(0)).alias(f"n{p}") for p in range(4)]
    counted = _counts(rows, Keys, spaced).groupBy("key").agg(*at)

    def heavy(of: tuple[int, ...]):
        n, m = (sum(F.col(f"n{2 * v + h}") for h in of) for v in (1, 0))
        n_all, m_all = (sum(sizes[2 * v + h] for h in of) for v in (1, 0))
        return (n >= LEAST_DOCS) & (F.log((n + 0.5) / (n_all + 1.0)) - F.log((m + 0.5) / (m_all + 1.0)) >= LEAST_WEIGHT - 1e-6)

    found = [Counter() for _ in range(4)]
    for r in counted.where(heavy((0,)) | heavy((1,)) | heavy((0, 1))).collect():  # words of the lexicons, about
        for p in range(4):
            found[p][r["key"]] = r[f"n{p}"]
    return found


FEATURES = ["x0", "x1", "x2", "x3", "x4"]


def weigh(rows: DataFrame, models: list[tuple[dict[str, float], CharacterModel]]) -> DataFrame:
    """Features of each document under the model that was learnt from the other half, and y."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = [Evidence(*m, kept=KEPT_TOKENS // 2) for m in models]
        for b in batches:
            places = b.column("place").to_numpy()
            x = np.array([evidence[1 - p % 2].features(t.as_py()) for t, p in zip(b.column("text"), places, strict=True)]).reshape(len(places), 5)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), pa.array(places // 2, pa.float64())], names=[*FEATURES, "y"])
        for e in evidence:
            e.clear()
            e.characters.forget()
        give_back()

    return rows.select("text", "place").mapInArrow(features, ", ".join(f"{n} double" for n in [*FEATURES, "y"]))


def calibrate(weighed: DataFrame) -> list[float]:
    """A logistic regression on all rows: in each step tasks sum slopes over their rows."""
    scale = np.array(weighed.agg(*(F.stddev_pop(n) for n in FEATURES)).first()) + 1e-9

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((6, 7))
            for b in batches:
                x = np.column_stack([np.ones(b.num_rows), *(b.column(n).to_numpy() for n in FEATURES)]) / np.array([1.0, *scale])
                hessian, gradient = slopes(x, b.column("y").to_numpy(), w)
                total += np.column_stack([hessian, gradient])
            yield pa.RecordBatch.from_pydict({"sums": [total.ravel().tolist()]})

        total = sum(np.array(r["sums"]).reshape(6, 7) for r in weighed.mapInArrow(part, "sums array<double>").collect())
        return total[:, :6], total[:, 6]

    w = newton(sums, 6, PENALTY)
    w[1:] /= scale
    return w.tolist()


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """From all documents (doc_id, text) that labels (doc_id, toxic: 0 or 1, others are left out) name.

    The calibration sees each document with a lexicon learnt from the other half of them; equal texts are in the same half.
    """
    rows = taught(documents, labels)
    bit = lambda i: F.shiftright("crc", i).bitwiseAND(1)
    found = {r["toxic"]: r for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), *(F.sum(bit(i)).alias(f"b{i}") for i in range(BITS))).collect()}
    n = [found[v]["n"] if v in found else 0 for v in (0, 1)]
    if min(n) < 4:
        release(rows.sparkSession, rows)
        share = (n[1] + 1) / (sum(n) + 2)
        return Model({}, CharacterModel.of([]), [math.log(share / (1 - share))] + [0.0] * 5)
    best = min(range(BITS), key=lambda i: (max(abs(found[v][f"b{i}"] / n[v] - 0.5) for v in (0, 1)), i))
    sizes = [n[v] - found[v][f"b{best}"] if half == 0 else found[v][f"b{best}"] for v in (0, 1) for half in (0, 1)]
    placed = rows.withColumn("place", (F.col("toxic") * 2 + bit(best)).cast("int"))
    grams = learn_grams(placed)
    # spaced words are learnt as the model of the others has them
    counts = learn_counts(placed, CharacterModel.of([], grams), sizes)

    def learnt(*halves: int) -> tuple[dict[str, float], CharacterModel]:
        toxic, others = (sum((counts[2 * v + h] for h in halves), Counter()) for v in (1, 0))
        n_toxic, n_others = (sum(sizes[2 * v + h] for h in halves) for v in (1, 0))
        lexicon = learn_lexicon(toxic, others, n_toxic, n_others) if n_toxic and n_others else {}
        # what is hidden is rather one of the lexicon's words
        return lexicon, CharacterModel.of([(w, 50.0) for w in lexicon if not w.endswith("~")], grams)

    weighed = materialise(weigh(placed, [learnt(0), learnt(1)]))
    coefficients = calibrate(weighed)
    release(rows.sparkSession, rows, weighed)
    return Model(*learnt(0, 1), coefficients)


def score_udf(model: Model):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        evidence, w = Evidence(model.lexicon, model.characters), np.array(model.coefficients)
        for texts in batches:
            x = np.array([evidence.features(t) for t in texts]).reshape(len(texts), 5)
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))
        evidence.clear()
        model.characters.forget()
        give_back()

    return score


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``documents`` with a score (0 to 1) and a prediction (1 from ``threshold`` on), learnt from ``labels`` (doc_id, toxic). Columns of
    ``documents`` that have one of ``names`` are replaced; other names keep them."""
    ship(documents.sparkSession)
    score = score_udf(fit(documents, labels))
    scored = documents.withColumn(names[0], score("text"))
    return scored.withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))
