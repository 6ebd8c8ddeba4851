"""Languages of documents and of the segments of mixed ones, with a confidence.

A sparse multinomial logistic regression on TF-IDF character n-grams of words, trained with the
follow-the-regularised-leader (proximal) method under an elastic net, then calibrated by one
temperature on held-out texts. It is fitted on a bounded sample of labelled texts; the documents are
classified whole, sentence by sentence, in one pass without a shuffle.

The features of a text are its n-grams' TF-IDF values divided by their sum, so a text's scores are
sums over its words. Each task scores a distinct word once and adds up rows of a score table.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codekin.llm.leakage import _INVISIBLE

LONGEST = 4  # n-grams of 1 to so many characters, with marks at the ends of a word
SCALE = 30.0  # constant factor of the features
LABELLED_ROWS = 20_000  # at most so many labelled texts are fitted on
CACHED_WORDS = 400_000
LEAST_WORDS = 12  # words of running prose from which on a document is in a language
SHORT = 4  # sentences of fewer words take the language of their neighbour
WINDOW = 4  # training texts are also cut into windows of so many words
ELSEWHERE = 0.02  # prior share of a language that the other sentences of a document do not show

_WORD = re.compile(r"(?<![\w$%@\\/=<>{}\[\]-])_?([^\W\d_]+(?:['’-][^\W\d_]+)*)_?(?![\w$%@\\/=<>{}\[\](]|-\d)")
_STOP = re.compile(r"[.!?…][\"'»”’)\]]*$")
_MARK = re.compile(r"(?:[>+*#-]|//|\d+(?:\.\d+)*\.?)$")
_SIGN = re.compile(r"[{}=\\]|^\|+$|/\*|\*/|->|::|:\w+_")  # brackets of code, table bars, assignments, comments, typed names
WORDS_A_SIGN = 8  # a line with such signs in two pieces or more, and fewer pieces for each, is no prose
KEPT_PIECES = 200_000  # pieces of text between white space whose words a task keeps at hand
LONG_PIECE = 40  # longer pieces are not kept
_pieces: dict[str, tuple[tuple[str, ...], int, bool, bool]] = {}


def unified(text: str) -> str:
    """Compatibility forms unified, invisible format characters removed; lines are kept."""
    return text if text.isascii() else unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))


def _piece(text: str) -> tuple[tuple[str, ...], int, bool, bool]:
    """The plain words of a piece without white space, their characters, whether it ends a sentence, and
    whether it has a sign of code."""
    words = tuple(_WORD.findall(text))
    got = words, sum(map(len, words)), bool(_STOP.search(text)), bool(_SIGN.search(text))
    if len(text) <= LONG_PIECE:
        if len(_pieces) >= KEPT_PIECES:
            _pieces.clear()
        _pieces[text] = got
    return got


def sentences(text: str | None) -> list[tuple[int, list[str]]]:
    """(paragraph, words) of each sentence of running prose, in lower case.

    A line is prose if most of its characters that are no white space belong to plain words (letters,
    without digits, underscores or signs of code attached) and signs of code are few. Lines of tables,
    graphs, listings, logs, digests and headers so drop out; neighbouring prose lines are one paragraph."""
    if not text:
        return []
    out: list[tuple[int, list[str]]] = []
    paragraph, open_ = 0, False
    words: list[str] = []
    for line in unified(text).lower().splitlines():
        parts = line.split()
        while parts and _MARK.match(parts[0]):
            del parts[0]
        prose = False
        if parts:
            pieces = [_pieces.get(p) or _piece(p) for p in parts]
            plain = sum([x[1] for x in pieces])
            prose = plain > 0 and plain >= 0.55 * sum(map(len, parts))
            if prose:
                signs = sum([x[3] for x in pieces])
                prose = signs < 2 or signs * WORDS_A_SIGN < len(parts)
        if prose:
            open_ = True
            for own, _, stops, _ in pieces:
                words += own
                if stops and words:
                    out.append((paragraph, words))
                    words = []
        elif open_:
            if words:
                out.append((paragraph, words))
                words = []
            paragraph, open_ = paragraph + 1, False
    if words:
        out.append((paragraph, words))
    return out


@lru_cache(maxsize=10_000)
def grams(word: str) -> tuple[str, ...]:
    """The character n-grams of a word, with marks at its ends."""
    marked = f"_{word}_"
    return tuple(marked[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(marked) - n + 1) if n > 1 or 0 < i < len(marked) - 1)


class LanguageModel:
    """Weights by n-gram and language; ``score`` gives the summands of a word."""

    def __init__(self, langs: list[str], vocabulary: dict[str, int], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, unseen: float):
        self.langs, self.vocabulary, self.idf, self.weights, self.bias = langs, vocabulary, idf, weights, bias
        self.unseen, self.temperature = unseen, 1.0

    def score(self, word: str) -> np.ndarray:
        """The scores of each language and, last, the mass by which their sum is divided."""
        out = np.zeros(len(self.langs) + 1, np.float32)
        for g in grams(word):
            i = self.vocabulary.get(g)
            if i is None:
                out[-1] += self.unseen
            else:
                out[:-1] += self.weights[i] * self.idf[i]
                out[-1] += self.idf[i]
        return out

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of texts from the sums of their words' scores."""
        z = (SCALE * sums[:, :-1] / np.maximum(sums[:, -1:], 1e-9) + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _windows(examples: list[tuple[list[str], str]], size: int) -> list[tuple[list[str], str]]:
    return [(words[k : k + size], label) for words, label in examples for k in range(0, max(1, len(words) - size + 1), size)]


def _folded(text: str, umlaut: str) -> str:
    """A text as it is typed without accents; ``umlaut`` stands for a diaeresis."""
    return "".join(umlaut if c == "\u0308" else c for c in unicodedata.normalize("NFD", text.casefold()) if c == "\u0308" or not unicodedata.combining(c))


def _examples(texts: list[str], labels: list[str]) -> list[tuple[list[str], str]]:
    """Sentences, each also as typed without accents, a diaeresis left out or written as an e."""
    out = []
    for text, label in zip(texts, labels):
        for _, words in sentences(text):
            joined = " ".join(words)
            forms = [joined, *sorted({_folded(joined, ""), _folded(joined, "e")} - {joined})]
            out += [(form.split(" "), label) for form in forms]
    return out


def train(
    texts: list[str], labels: list[str], alpha: float = 1.0, beta: float = 1.0, l1: float = 0.2, l2: float = 0.05,
    epochs: int = 2, held_out: float = 0.2, seed: int = 7,
) -> LanguageModel:
    """Fit on all texts, after finding the temperature with a model that did not see ``held_out`` of
    them; it is set on windows of two words, as longer ones leave hardly any error to calibrate by."""
    langs = sorted(set(labels))
    if not langs:
        return LanguageModel([], {}, np.empty(0), np.empty((0, 0)), np.empty(0), 1.0)
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < held_out

    def subset(mask: np.ndarray) -> list[tuple[list[str], str]]:
        return _examples([t for t, m in zip(texts, mask) if m], [x for x, m in zip(labels, mask) if m])

    trial = _fit(subset(~held), langs, alpha, beta, l1, l2, epochs, rng)
    test = _windows(subset(held), 2)
    model = _fit(subset(np.ones(len(texts), bool)), langs, alpha, beta, l1, l2, epochs, rng)
    if test:
        sums = np.array([np.sum([trial.score(w) for w in words], axis=0) for words, _ in test])
        truth = np.array([langs.index(label) for _, label in test])

        def loss(t: float) -> float:
            trial.temperature = t
            return -np.log(np.maximum(trial.probabilities(sums)[np.arange(len(truth)), truth], 1e-12)).mean()

        model.temperature = min(np.geomspace(0.2, 5, 60), key=loss)
    return model


def _fit(examples, langs, alpha, beta, l1, l2, epochs, rng) -> LanguageModel:
    """Follow-the-regularised-leader, one example at a time, per-coordinate rates."""
    examples = [*examples, *_windows(examples, WINDOW)]
    counts = [Counter(chain.from_iterable(map(grams, words))) for words, _ in examples]
    df = Counter(g for c in counts for g in c)
    vocabulary = {g: i for i, g in enumerate(sorted(df))}
    n = len(examples)
    idf = np.array([np.log((1 + n) / (1 + df[g])) + 1 for g in vocabulary])
    unseen = float(np.log(1 + n) + 1)
    k = len(langs)
    z, squares = np.zeros((len(vocabulary) + 1, k)), np.zeros((len(vocabulary) + 1, k))
    rows = []
    for c, (_, label) in zip(counts, examples):
        index = np.array([vocabulary[g] for g in c])
        x = np.array([float(v) for v in c.values()]) * idf[index]
        rows.append((np.append(index, len(vocabulary)), np.append(SCALE * x / x.sum(), 1.0), langs.index(label)))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            index, x, y = rows[r]
            zi, ni = z[index], squares[index]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = ni + g * g
            z[index] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            squares[index] = more
    w = weights(z, squares)
    return LanguageModel(langs, vocabulary, idf.astype(np.float32), w[:-1].astype(np.float32), w[-1], unseen)


def fitted(samples: DataFrame, lang_col: str, text_col: str, most: int = LABELLED_ROWS) -> LanguageModel:
    """A model from labelled texts; at most ``most`` rows, those with the smallest hashes. Rows with a null
    or blank language or text are left out; without any rows the model knows no language."""
    rows = samples.select(F.lower(F.trim(lang_col)).alias("l"), F.col(text_col).alias("t")).where("l <> '' AND t <> ''")
    rows = rows.orderBy(F.xxhash64("t"), "t", "l").limit(most).collect()
    return train([r["t"] for r in rows], [r["l"] for r in rows])


def in_context(p: np.ndarray, n: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Probabilities of sentences, with the languages of the other sentences of their document as prior.

    ``n`` are the sentences' words, ``owner`` their documents, in order. A sentence's own words are not
    in its prior, so the only sentence of a document keeps its probabilities."""
    firsts = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
    counts = np.diff(firsts, append=len(n))
    own = p * n[:, None]
    others = np.maximum(np.repeat(np.add.reduceat(own, firsts, axis=0), counts, axis=0) - own, 0)
    total = others.sum(axis=1, keepdims=True)
    alone = np.repeat(counts, counts) == 1
    prior = np.where(alone[:, None], 1.0, others / np.maximum(total, 1e-9) + ELSEWHERE)
    p = p * prior
    return p / p.sum(axis=1, keepdims=True)


class _ScoredWords(dict):
    """Row of each word in a table of scores; a word is scored when it is first asked for."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.table = model, np.zeros((1024, len(model.langs) + 1), np.float32)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        if i >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[i] = self.model.score(word)
        return i


def _classify(shared):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        known = _ScoredWords(model)
        for batch in it:
            if len(known) > CACHED_WORDS:
                known = _ScoredWords(model)
            flat, lengths, owner, paragraphs = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist() if model.langs else []):
                for paragraph, words in sentences(text):
                    flat.extend(map(known.__getitem__, words))
                    lengths.append(len(words))
                    owner.append(row)
                    paragraphs.append(paragraph)
            if lengths:
                n = np.array(lengths)
                sums = np.add.reduceat(known.table[np.array(flat)], np.cumsum(n) - n, axis=0)
                p = model.probabilities(sums.astype(np.float64))
                p = in_context(p, n, np.array(owner))
                best = p.argmax(axis=1)
            else:
                best = np.empty(0, np.int64)
            best, where = best.tolist(), owner
            # a short sentence takes the language of the one before it, or after it, in its paragraph
            for i in range(len(best)):
                if lengths[i] < SHORT:
                    if i and where[i - 1] == where[i] and paragraphs[i - 1] == paragraphs[i]:
                        best[i] = best[i - 1]
                    elif i + 1 < len(best) and where[i + 1] == where[i] and paragraphs[i + 1] == paragraphs[i]:
                        best[i] = best[i + 1]
            sure = p[np.arange(len(best)), best].tolist() if best else []  # of the language given
            langs, words, confidence, owners = [], [], [], []
            for i in range(len(best)):
                lang = model.langs[best[i]]
                if owners and owners[-1] == where[i] and langs[-1] == lang:
                    words[-1] += lengths[i]
                    confidence[-1] += sure[i] * lengths[i]
                else:
                    owners.append(where[i])
                    langs.append(lang)
                    words.append(lengths[i])
                    confidence.append(sure[i] * lengths[i])
            offsets = np.searchsorted(np.array(owners, np.int64), np.arange(batch.num_rows + 1))
            values = pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.int32()), pa.array([c / w for c, w in zip(confidence, words)], pa.float64())],
                ["lang", "n_words", "confidence"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["doc_id", "label", "segments"]
            )

    return batches


def segmented(docs: DataFrame, id_col: str, text_col: str, label_col: str, model: LanguageModel) -> DataFrame:
    """(doc_id, label, segments) of each row: segments are maximal runs of sentences in one language,
    with their words of prose and mean confidence. Texts without prose, null and empty ones have an
    empty list. Extra columns are not read; repeated rows stay repeated."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(
        _classify(shared), "doc_id long, label string, segments array<struct<lang string, n_words int, confidence double>>"
    )


def document_languages(segments: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, label, languages) of each row of ``segmented``: the languages with at least
    ``least_words`` words, with their words and confidence, most words first."""
    names = F.array_distinct(F.transform("segments", lambda s: s["lang"]))

    def total(lang: Column) -> Column:
        own = F.filter("segments", lambda s: s["lang"] == lang)
        words = F.aggregate(own, F.lit(0), lambda a, s: a + s["n_words"])
        sure = F.aggregate(own, F.lit(0.0), lambda a, s: a + s["n_words"] * s["confidence"])
        return F.struct((-words).alias("order"), lang.alias("lang"), words.alias("n_words"), F.round(sure / words, 6).alias("confidence"))

    languages = F.filter(F.transform(names, total), lambda x: x["n_words"] >= least_words)
    return segments.select("doc_id", "label", F.array_sort(languages).alias("languages"))


#: Names and codes of the languages, in lower case: fixed values.
NAMES = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "it": ["it", "ita", "italian", "italiano"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "ru": ["ru", "rus", "russian", "русский"],
}


def label_language(label: Column) -> Column:
    """The two-letter language a label names, or null: codes, names, with a region, in any case."""
    name = F.regexp_replace(F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[-_.@].*$", "")
    known = F.create_map(*[F.lit(x) for lang, names in NAMES.items() for n in names for x in (n, lang)])
    return known[name]


def wrong_labels(languages: DataFrame) -> DataFrame:
    """(doc_id, lang), once each: the language of documents in exactly one whose label does not name
    it, and every language of documents in several. Null ids are left out."""
    own = F.transform("languages", lambda x: x["lang"])
    named = label_language(F.col("label"))
    case = (F.size("languages") > 1) | ((F.size("languages") == 1) & ~F.coalesce(named == own[0], F.lit(False)))
    return languages.where(case & F.col("doc_id").isNotNull()).select("doc_id", F.explode(own).alias("lang")).distinct()
