"""Languages of texts and of their segments, by unigram pieces summed over all segmentations."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyral.llm.tokens import load_ranks

#: The fixed vocabulary, a parameter of fit(); pieces up to LONGEST bytes take part.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LONGEST = 10
#: Labelled texts per language at most, chosen by a hash, and their longest length, from which the model is fitted; bytes of the
#: parts in which long sentences are fitted; one text in HELD_OUT is kept back to calibrate the confidence.
FIT_TEXTS, FIT_CHARS, FIT_ROUNDS, FIT_BYTES, HELD_OUT = 200, 4_000, 3, 240, 5
#: Shares of a text's evidence among which calibration chooses, and the share of labels it takes for wrong.
SHARES, WRONG_LABELS = tuple(0.02 * 1.25**i for i in range(18)), 0.1
#: Letter runs longer than this are no words.
LONGEST_WORD = 40
#: Sentences, and their scores, that a worker remembers: speed only depends on it.
REMEMBERED = 65_536
#: Letter runs a spaced sentence has at least, ideographs an unspaced one has at least.
FEWEST_WORDS, FEWEST_IDEOGRAPHS = 4, 6
#: Sentences that make a text speak a language.
SENTENCES = 2

_WRONG = re.compile("[\x80-\xffŒœŠšŸŽžƒˆ˜–—‘-‚“-„†-•…‰‹›€™]{2,}")
_MARKUP = re.compile(r"<[^<>\n]{0,200}>|&[a-zA-Z]{2,8};|&#\d+;|\[n/a\]")
_QUOTED = re.compile(r"[„“”\"«]([^„“”\"«»\n]{1,40})[“”\"»]:?")
_END = re.compile(r"(?<=[.!?])(?:[^\w\s]|[µªº²³¹¼½¾])*\s+|(?<=[。！？])|[\r\n]+")
_CODED = re.compile(r"[\w!-/:-@\[-`{-~]*[0-9][\w!-/:-@\[-`{-~]*", re.ASCII)
_WORD = re.compile(r"[^\W\d_]{2,}")
_IDEOGRAPH = re.compile(r"[㐀-鿿豈-﫿]")
_RUN = re.compile(r"[^\W\d_]{%d,}" % (LONGEST_WORD + 1))
_OTHER = re.compile(r"[^\w'’]+|[\d_]+")


def repair(text: str) -> str:
    """UTF-8 that was read as a one-byte code page, put right where it can be."""

    def back(m: re.Match) -> str:
        raw = bytearray()
        for c in m.group():
            try:
                raw += c.encode("cp1252")
            except UnicodeEncodeError:
                if ord(c) > 255:
                    return m.group()
                raw.append(ord(c))
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _WRONG.sub(back, text)


@lru_cache(REMEMBERED)
def _plain_form(part: str) -> tuple[bool, str]:
    """Whether a line or sentence is a full sentence, and its plain form: letters, without codes, ids and over-long runs."""
    bare = _CODED.sub(" ", part)
    letters = _WORD.findall(bare)
    if letters and max(map(len, letters)) > LONGEST_WORD:
        bare = _RUN.sub(" ", bare)
        letters = _WORD.findall(bare)
    full = len(letters) >= FEWEST_WORDS or len(_IDEOGRAPH.findall(bare)) >= FEWEST_IDEOGRAPHS
    return full, " " + _OTHER.sub(" ", unicodedata.normalize("NFC", bare).lower()).strip()


def segments(text: str | None) -> list[tuple[str, str]]:
    """(sentence, its plain form) of each full sentence; ids, numbers, paths, code, records and quoted words are none."""
    out = []
    for part in _END.split(_QUOTED.sub(" ", _MARKUP.sub("", repair(text)))) if text else ():
        part = part.strip(" \t>|*#-")
        full, plain = _plain_form(part)
        if full:
            out.append((part, plain))
    return out


def whole(text: str) -> str:
    """The plain form of a text that has no full sentence: all its letters; blank if there are none."""
    return " ".join(x for x in (_plain_form(p)[1].strip() for p in _END.split(_MARKUP.sub("", repair(text)))) if x)


def bare_letters(text: str) -> str:
    """Without accents."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))


class Pieces:
    """Finds all pieces of a fixed vocabulary at all places of many texts at once."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[bytes]) -> None:
        self.count = len(pieces)
        self.tables = {}
        for size in sorted({len(p) for p in pieces}):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == size])
            raw = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, size)
            key = np.zeros(len(ids), np.uint64)
            for c in range(size):
                key = key * self.MULTIPLIER + raw[:, c].astype(np.uint64) + np.uint64(1)
            order = np.argsort(key)
            self.tables[size] = key[order], ids[order]

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Lengths, and per piece size the piece id (or -1) that starts at [text, place]."""
        lengths = np.array([len(t) for t in texts])
        width = int(lengths.max(initial=1))
        raw = np.zeros((len(texts), width), np.uint64)
        for i, t in enumerate(texts):
            raw[i, : len(t)] = np.frombuffer(t, np.uint8)
        raw += np.uint64(1)
        key, found = np.zeros_like(raw), {}
        for size in range(1, LONGEST + 1):
            if size > width:
                break
            key = key[:, : width - size + 1] * self.MULTIPLIER + raw[:, size - 1 :]
            if size in self.tables:
                keys, ids = self.tables[size]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[at] == key) & (np.arange(width - size + 1)[None, :] + size <= lengths[:, None])
                found[size] = np.where(hit, ids[at], -1)
        return lengths, found


class Model:
    """Piece probabilities per language: p has a row per piece and a last row of zeros, a column per language."""

    def __init__(self, languages: list[str], pieces: list[bytes], p: np.ndarray) -> None:
        self.languages, self.pieces, self.p = languages, Pieces(pieces), np.vstack([p, np.zeros((1, p.shape[1]))])
        self.share = 1.0
        self.known: dict[bytes, np.ndarray] = {}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Log-probability of each text in each language: the forward algorithm, summed over all segmentations."""
        out = np.zeros((len(texts), len(self.languages)))
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        start = 0
        while start < len(order):
            size = max(1, min(512, 65_536 // max(1, len(texts[order[start]]))))
            part = order[start : start + size]
            out[part] = self._forward([texts[i] for i in part])
            start += size
        return out

    def confidences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest language of each text and its calibrated probability; scores of texts seen before are remembered."""
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(dict.fromkeys(texts))
        self.known.update(zip(new, self.scores(new)))
        ll = np.array([self.known[t] for t in texts]).reshape(len(texts), len(self.languages))
        part = np.exp(self.share * (ll - ll.max(1, keepdims=True)))
        return ll.argmax(1), part.max(1) / part.sum(1)

    def calibrate(self, texts: list[tuple[str, bytes]]) -> None:
        """Sets the share of a text's evidence that counts, so that (label, text) held out from the fit are likeliest.

        Pieces of one sentence are not independent, so that less than all of it counts; wrong labels lower it further.
        """
        if not texts:
            return
        number = {x: i for i, x in enumerate(self.languages)}
        ll, own = self.scores([t for _, t in texts]), np.array([number[x] for x, _ in texts])
        ll = ll - ll.max(1, keepdims=True)
        fits = lambda share: np.log((1 - WRONG_LABELS) * np.exp(share * ll[np.arange(len(own)), own]) / np.exp(share * ll).sum(1) + WRONG_LABELS / len(number)).sum()
        self.share = max(SHARES, key=fits)

    def _forward(self, texts: list[bytes]) -> np.ndarray:
        lengths, found = self.pieces.find(texts)
        n, width, k = len(texts), int(lengths.max(initial=0)), len(self.languages)
        ring = np.zeros((LONGEST + 1, n, k))
        ring[0] = 1
        logs, result = np.zeros((n, k)), np.zeros((n, k))
        for t in range(1, width + 1):
            now = np.zeros((n, k))
            for size, ids in found.items():
                if size <= t:
                    column = ids[:, t - size]
                    if (column >= 0).any():
                        now += ring[(t - size) % (LONGEST + 1)] * self.p[column]
            ring[t % (LONGEST + 1)] = now
            if t % 8 == 0 or t == width:
                most = ring.max(0)
                most[most <= 0] = 1
                ring /= most
                logs += np.log(most)
            ends = np.flatnonzero(lengths == t)
            if len(ends):
                result[ends] = np.log(np.maximum(ring[t % (LONGEST + 1)][ends], 1e-300)) + logs[ends]
        return result


def fit(texts: list[tuple[str, str]], languages: list[str], vocabulary: str = VOCABULARY, rounds: int = FIT_ROUNDS) -> Model:
    """texts (language, text) with some wrong labels -> Model.

    Rounds of expectation maximisation: expected piece counts over all segmentations, by forward and backward sums,
    then sentences move to the language that scores best, the labels they were seen under counting as a prior only. One text
    in HELD_OUT takes no part; on its sentences the confidence is calibrated.
    """
    number = {x: i for i, x in enumerate(languages)}
    votes: dict[bytes, np.ndarray] = {}
    held: list[tuple[str, bytes]] = []
    for n, (label, text) in enumerate(texts):
        for _, plain in segments(text):
            if n % HELD_OUT == HELD_OUT - 1:
                held.append((label, plain.encode("utf-8", "replace")))
                continue
            for form in {plain, bare_letters(plain)}:
                for part in _fitted_parts(form.encode("utf-8", "replace")):
                    votes.setdefault(part, np.zeros(len(languages)))[number[label]] += 1
    forms = list(votes)
    said = np.array(list(votes.values())).reshape(len(forms), len(languages))
    weight = np.minimum(said.sum(1), 20)
    lead = np.log((said + 0.3) / (said + 0.3).sum(1, keepdims=True))
    pieces = [p for p in load_ranks(vocabulary)[0] if len(p) <= LONGEST]
    flat = Pieces(pieces)
    spots = []
    for i in range(0, len(forms), 512):
        lengths, found = flat.find(forms[i : i + 512])
        spots.append((i, lengths, found))
    used = np.zeros(len(pieces), bool)
    used[[i for i, p in enumerate(pieces) if len(p) == 1]] = True
    for _, _, found in spots:
        for ids in found.values():
            used[ids[ids >= 0]] = True
    k, now = len(languages), lead.argmax(1)
    p = None
    for turn in range(rounds):
        counts = np.zeros((len(pieces) + 1, k))
        for i, lengths, found in spots:
            own = now[i : i + len(lengths)]
            _expect(counts, lengths, found, own, weight[i : i + len(lengths)], p)
        p = _probabilities(counts[:-1], used)
        p = np.vstack([p, np.zeros((1, k))])
        model = Model(languages, [x for x, u in zip(pieces, used) if u], p[:-1][used])
        if len(forms) and turn < rounds - 1:
            now = (model.scores(forms) + lead).argmax(1)
    model.calibrate(held)
    return model


def _fitted_parts(form: bytes) -> list[bytes]:
    """A sentence in parts of at most FIT_BYTES, cut after a space where there is one and never within a character."""
    parts = []
    while len(form) > FIT_BYTES:
        at = form.rfind(b" ", 1, FIT_BYTES)
        if at < 1:
            at = FIT_BYTES
            while at > 1 and form[at] & 0xC0 == 0x80:
                at -= 1
        parts.append(form[:at])
        form = form[at:]
    return [*parts, form]


def _probabilities(counts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Counts per language, smoothed by the counts of all languages and a little of every used piece."""
    every = counts.sum(1) + 0.5 * used
    share = every / every.sum()
    total = counts.sum(0)
    return (counts + 0.02 * np.maximum(total, 100)[None] * share[:, None]) / (total + 0.02 * np.maximum(total, 100))[None]


def _expect(counts: np.ndarray, lengths: np.ndarray, found: dict, own: np.ndarray, weight: np.ndarray, p: np.ndarray | None) -> None:
    """Adds the expected piece counts of texts under their own language; without p every segmentation weighs by size."""
    n, width = len(lengths), int(lengths.max(initial=0))
    score = {}
    for size, ids in found.items():
        score[size] = np.where(ids >= 0, 0.01 * size if p is None else p[ids, own[:, None]], 0).astype(np.longdouble)
    ahead, behind = np.zeros((n, width + 1), np.longdouble), np.zeros((n, width + 1), np.longdouble)
    ahead[:, 0] = 1
    behind[np.arange(n), lengths] = 1
    for t in range(1, width + 1):
        for size, s in score.items():
            if size <= t:
                ahead[:, t] += ahead[:, t - size] * s[:, t - size]
    for t in range(width - 1, -1, -1):
        for size, s in score.items():
            if t + size <= width:
                behind[:, t] += behind[:, t + size] * s[:, t]
    whole = ahead[np.arange(n), lengths]
    for size, s in score.items():
        places = s.shape[1]
        part = (ahead[:, :places] * s * behind[:, size : size + places] / np.maximum(whole, np.longdouble(1e-4900))[:, None]).astype(float) * weight[:, None]
        row, col = np.nonzero(part > 1e-6)
        np.add.at(counts, (found[size][row, col], own[row]), part[row, col])


def stated(label: Column, languages: DataFrame) -> tuple[Column, list[str]]:
    """The language code a label states, by code, iso3 or English name in any case, with or without region; else null."""
    names: dict[str, str] = {}
    codes = []
    for code, iso3, english in languages.select("lang_code", "iso3", "english_name").collect():
        if code is not None:
            codes.append(code)
            names |= {x.strip().lower(): code for x in (code, iso3, english) if x}
    first = F.regexp_extract(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), r"^(\p{L}+)([-_][a-z0-9]+)*$", 1)
    table = F.create_map(*(F.lit(x) for pair in (names or {"": ""}).items() for x in pair))
    return F.nullif(F.try_element_at(table, first), F.lit("")), sorted(set(codes))


def fitted(docs: DataFrame, languages: DataFrame, vocabulary: str = VOCABULARY) -> Model:
    """The model of docs(id, text, lang): from at most FIT_TEXTS labelled texts of each language, of FIT_CHARS at most, chosen by a hash."""
    code, codes = stated(F.col("lang"), languages)
    some = docs.withColumn("code", code).filter(F.col("code").isNotNull() & (F.length("text") <= FIT_CHARS))
    w = Window.partitionBy("code").orderBy(F.xxhash64(F.lit(8), "id"), "id")
    sample = some.select("code", "id", "text").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= FIT_TEXTS).select("code", "text").collect()
    return fit([(r[0], r[1]) for r in sample], codes, vocabulary)


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """docs(id, text) -> (id, segment, text, lang, confidence, sentence): one row per full sentence, numbered from 0.

    A text without a full sentence is one segment with sentence = false, judged by all its letters; without letters its
    language is null and the confidence 0. Null and empty texts have no rows. confidence: the language's probability by
    the share of the evidence that calibration has found to count. Whole texts are read, however long. One narrow pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names = np.array([*model.languages, None], object)
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"]):
                found = segments(text)
                rows += [(i, n, s, plain, True) for n, (s, plain) in enumerate(found)] if found else [(i, 0, text, whole(text), False)] if text else []
            if not rows:
                continue
            ids, numbers, texts, plain, full = zip(*rows)
            best, sure = model.confidences([x.encode("utf-8", "replace") for x in plain])
            none = np.array([not x.strip() for x in plain])
            yield pd.DataFrame({"id": ids, "segment": np.array(numbers, np.int32), "text": texts, "lang": names[np.where(none, len(names) - 1, best)], "confidence": np.where(none, 0, sure).round(6), "sentence": full})

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").filter(F.col("text").isNotNull()).mapInPandas(run, f"id {kind}, segment int, text string, lang string, confidence double, sentence boolean")


def spoken(found: DataFrame, sentences: int = SENTENCES) -> DataFrame:
    """(id, lang, sentences, confidence): each language of which a text holds at least `sentences` full sentences."""
    return languages_of(found, sentences).filter("spoken").drop("spoken")


def languages_of(found: DataFrame, sentences: int = SENTENCES) -> DataFrame:
    """(id, lang, sentences, confidence, spoken): every language found in a text, with its full sentences; spoken: at least `sentences` of them."""
    n = F.count_if("sentence")
    return found.groupBy("id", "lang").agg(n.alias("sentences"), F.round(F.avg("confidence"), 6).alias("confidence"), (n >= sentences).alias("spoken"))


def unstated(docs: DataFrame, found: DataFrame, languages: DataFrame) -> DataFrame:
    """(id, lang, ...): spoken languages that the text's label, docs(id, lang), does not state."""
    code, _ = stated(F.col("lang"), languages)
    labels = docs.select("id", code.alias("stated"))
    return spoken(found).join(labels, "id").filter(~F.col("lang").eqNullSafe(F.col("stated"))).drop("stated")
