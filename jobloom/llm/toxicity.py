"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding resolves compatibility forms, lower-cases, replaces letters of other scripts that look Latin, letters
in boxes and digits that stand for letters, and turns punctuation into blanks. A word with accents is matched
as it is and once more without them, since accents tell words apart but also disguise them. The lexicon
holds words and word beginnings with their log-odds, learned from a bounded sample of labelled rows. Support
is counted in distinct neighbourhoods (word before, word after) and not in documents, so that copies of one
text do not make its words toxic. A term beside a word that makes it harmless is an exception phrase: what
clean texts say in such phrases does not count against the term, and in a text the phrase takes the term's
weight back. The sum of weights is normalised by length and turned into a probability by a logistic curve
fitted to the sample.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.labelled import held_out, labelled_texts, logistic, training_sample
from jobloom.llm.memory import give_back
from jobloom.llm.scratch import materialize

#: At most this many rows of each label teach.
TRAINING_ROWS = {0: 6000, 1: 3000}
#: Neighbourhoods that a term needs; letters of a word beginning.
LEAST_SUPPORT, BEGINNINGS = 5, (3, 4, 5, 6, 7, 8)
LEAST_SHARE = 0.002  # of the toxic sample, as support
#: The least log-odds of a term, and of what is looked at beside its neighbours.
LEAST_ODDS, CANDIDATE_ODDS = 4.5, 0.3

# Letters that look like Latin ones, and digits and signs that stand for letters.
_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝвнкмтгпзӏυαεορτχικνβηωɑɡıℓꞵƅҽⅼ",
        "aeopcyxijshdqwbhkmtrn3luaeoptxikvbnwagilbbel",
        strict=True,
    )
)
_DIGITS = dict(zip("01345789@$", "oieastbgas", strict=True))
#: Code points of an A whose alphabet has no compatibility form: letters in circles and boxes, and flags.
_BOXED = (0x1F150, 0x1F170, 0x1F1E6)


def _fold_table() -> dict[int, str]:
    table = {code: " " for code in range(0x21, 0x7F) if not chr(code).isalnum()}
    table |= {code: " " for code in (*range(0x09, 0x0E), 0xA0, *range(0x2000, 0x2070), 0x3000, 0xAB, 0xBB, 0xA1, 0xBF)}
    table |= {code: "" for code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0xFE00, 0xFE10))}
    table |= {code: "" for code in range(0x300, 0x370)}  # marks that no letter takes in
    table |= {first + k: chr(97 + k) for first in _BOXED for k in range(26)}
    return table | {ord(a): b for a, b in (_LOOKALIKES | _DIGITS).items()}


_FOLD = _fold_table()


def fold(text: str | None) -> str:
    """Folded text between blanks."""
    text = (text or "").lower() if (text or "").isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).lower())
    return f" {text.translate(_FOLD)} "


def bare(word: str) -> str:
    """A folded word without accents."""
    return word if word.isascii() else unicodedata.normalize("NFKD", word).translate(_FOLD)


def _bare_words(folded: str) -> str:
    """The words that lose accents, without them, between blanks."""
    if folded.isascii():
        return ""
    found = [b for w in folded.split() if not w.isascii() and (b := bare(w)) != w]
    return f" {' '.join(found)} " if found else ""


@dataclass
class Lexicon:
    """``terms``: `` word `` or `` beginning`` to weight; ``exceptions``: (phrase, whether its first word is meant) to the weight taken back."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: dict[tuple[str, bool], float] = field(default_factory=dict)
    slope: float = 0.0
    intercept: float = 0.0

    def automaton(self):
        """Finds (weight of a term, [(characters from the meant word to the phrase's end, weight taken back)])."""
        import ahocorasick

        payload: dict[str, tuple[float, list[tuple[int, float]]]] = {term: (weight, []) for term, weight in self.terms.items()}
        for (phrase, first), weight in self.exceptions.items():
            back = len(phrase) - 1 if first else len(phrase) - phrase.rindex(" ", 0, -1) - 1
            payload.setdefault(phrase, (0.0, []))[1].append((back, weight))
        found = ahocorasick.Automaton()
        for text, value in payload.items():
            found.add_word(text, value)
        found.make_automaton()
        return found


def density(weight: float, length: int) -> float:
    """Weight per length: grows with the terms, shrinks with the characters around them."""
    return float(np.log1p(1000 * max(weight, 0.0) / (length + 500)))


def _weight(automaton, text: str) -> float:
    """The weights of all terms, less those of words that stand in an exception phrase, once a word."""
    if not len(automaton):
        return 0.0
    total, excused = 0.0, {}
    for end, (weight, phrases) in automaton.iter(text):
        total += weight
        for back, taken in phrases:
            excused[end - back] = max(excused.get(end - back, 0.0), taken)
    total += sum(weight for _, (weight, _) in automaton.iter(_bare_words(text)))
    return total - sum(excused.values())


def _density_of(automaton, folded: str) -> float:
    return density(_weight(automaton, folded), len(folded) - 2)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array([fold(text) for text in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["text", "y"])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, which bound what a task holds as Python strings."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
        give_back()


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, hash of it and the words around it), once a batch."""
    import xxhash

    for batch in _slices(batches):
        seen: set[tuple[str, int]] = set()
        for text in batch.column(0).to_pylist():
            words = ["", *text.split(), ""]
            for before, word, after in zip(words, words[1:], words[2:]):
                around = xxhash.xxh3_64_intdigest(f"{before} {word} {after}") >> 1
                seen |= {(word, around), (bare(word), around)}
        found, around = zip(*seen, strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.string()), pa.array(around, pa.int64())], names=["word", "around"]
        )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, occurrences), summed over about 100,000 distinct words at a time."""
    counts: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    for batch in _slices(batches):
        for folded in batch.column(0).to_pylist():
            counts.update(folded.split())
            counts.update(_bare_words(folded).split())
        if len(counts) >= 100_000:
            yield counted()
            counts.clear()
    yield counted()


def _occurrences(terms: list[str]):
    """(term, before, word, after, y) for every occurrence of the terms in labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = Lexicon(dict.fromkeys(terms, 1.0)).automaton(), set(terms)
        for batch in _slices(batches):
            rows = []
            for folded, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not known or next(automaton.iter(folded), None) is None:
                    continue
                words = ["", *folded.split(), ""]
                for before, word, after in zip(words, words[1:], words[2:]):
                    for term in (f" {word} ", *(f" {word[:n]}" for n in BEGINNINGS if len(word) > n)):
                        if term in known:
                            rows.append((term, before, word, after, y))
            columns = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["term", "before", "word", "after", "y"])

    return run


def _densities(lexicon: Lexicon, prepare=fold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in _slices(batches):
            values = [_density_of(automaton, prepare(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.float64())], names=[batch.schema.names[0], "density"]
            )

    return run


def learn_lexicon(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: dict[int, int] | None = None) -> Lexicon:
    """A lexicon of all telling terms in at most ``most`` rows of each label (``TRAINING_ROWS``), one row an id, that may teach."""
    sample = labelled_texts(docs, training_sample(labels, label, most or TRAINING_ROWS))
    sample = materialize(sample.select("text", "y").mapInArrow(_folded, "text string, y int"), "labelled")
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    around = sample.filter("y = 1").select("text").mapInArrow(_neighbourhoods, "word string, around long")
    by_word = around.distinct().groupBy("word").agg(F.count("*").alias("n"))
    met = sample.filter("y = 0").select("text").mapInArrow(_word_counts, "word string, n long")
    by_word_clean = met.groupBy("word").agg(F.sum("n").alias("n"))
    beginnings = [F.when(F.length("word") > n, F.concat(F.lit(" "), F.left("word", F.lit(n)))) for n in BEGINNINGS]
    terms_of = F.explode(F.array_compact(F.array(F.concat(F.lit(" "), "word", F.lit(" ")), *beginnings))).alias("term")
    p = by_word.select(terms_of, "n").groupBy("term").agg(F.sum("n").alias("p"))
    n = by_word_clean.select(terms_of, "n").groupBy("term").agg(F.sum("n").alias("n"))
    least = max(LEAST_SUPPORT, int(LEAST_SHARE * toxic))
    counts = p.filter(F.col("p") >= least).join(n, "term", "left").select("term", "p", F.coalesce("n", F.lit(0)).alias("n"))

    def odds_of(met: Column) -> Column:
        return F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((met + 0.5) / (clean + 1))

    # What the sample holds bounds these rows; none is cut off.
    candidates = {r["term"]: (r["p"], r["n"]) for r in counts.filter(odds_of(F.col("n")) >= CANDIDATE_ODDS).collect()}
    phrases, excused = _exceptions(sample, list(candidates))
    odds, support_of = {}, {}
    for term, (p_, n_) in candidates.items():
        value = np.log((p_ + 0.5) / (toxic + 1)) - np.log((max(0, n_ - excused.get(term, 0)) + 0.5) / (clean + 1))
        if value >= LEAST_ODDS:
            odds[term], support_of[term] = float(value), p_
    if not odds:
        return Lexicon(slope=0.0, intercept=-30.0 if clean else 0.0)
    # A beginning gives way to a longer term that covers nearly the same texts, and then longer terms give
    # way to a beginning about as telling.
    covered: dict[str, float] = defaultdict(float)
    for term in odds:
        for n in BEGINNINGS:
            if n + 1 < len(term):
                covered[term[: n + 1]] = max(covered[term[: n + 1]], support_of[term])
    terms: dict[str, float] = {}
    for term in sorted(odds, key=lambda t: (len(t.rstrip()), t.endswith(" "))):
        shorter = max((terms.get(term[: n + 1], 0.0) for n in BEGINNINGS if n + 1 < len(term)), default=0.0)
        if covered[term] < 0.9 * support_of[term] and shorter < odds[term] - 1:
            terms[term] = odds[term]
    exceptions: dict[tuple[str, bool], float] = defaultdict(float)
    for term, phrase, first in phrases:
        if term in terms:
            exceptions[phrase, first] += terms[term]
    lexicon = Lexicon(terms, dict(exceptions))
    numbered = sample.select(F.col("y"), "text").mapInArrow(_densities(lexicon, prepare=str), "y int, density double")
    points = numbered.collect()  # one row an id of the bounded sample
    x, y = np.array([r["density"] for r in points]), np.array([r["y"] for r in points])
    lexicon.slope, lexicon.intercept = logistic(x, y)
    return lexicon


def _exceptions(sample: DataFrame, candidates: list[str]) -> tuple[list[tuple[str, str, bool]], dict[str, int]]:
    """Exception phrases, and how often clean texts say a term in one.

    A phrase is a term's word with a neighbour that is at home in clean texts and not in toxic ones:
    ``(term, phrase, whether the term's word comes first)``.
    """
    met = sample.mapInArrow(_occurrences(candidates), "term string, before string, word string, after string, y int")
    met = met.groupBy("term", "before", "word", "after", "y").agg(F.count("*").alias("n"))
    met = materialize(met, "occurrences")
    sides = met.select("term", "y", "n", "before", "word", "after", F.explode(F.array(
        F.struct(F.concat(F.lit(" "), "word", F.lit(" "), "after", F.lit(" ")).alias("phrase"), F.lit(True).alias("first"), (F.col("after") != "").alias("ok")),
        F.struct(F.concat(F.lit(" "), "before", F.lit(" "), "word", F.lit(" ")).alias("phrase"), F.lit(False).alias("first"), (F.col("before") != "").alias("ok")),
    )).alias("s"))
    sides = sides.filter("s.ok").select("term", "y", "n", "before", "word", "after", "s.phrase", "s.first")
    # Toxic texts count by neighbourhood, as for terms; clean ones by occurrence.
    counts = sides.groupBy("term", "phrase", "first").agg(F.sum("y").alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n"))
    found = materialize(counts.filter((F.col("n") >= LEAST_SUPPORT) & (F.col("n") > 10 * F.col("p"))).select("term", "phrase", "first"), "phrases")
    covered = sides.filter("y = 0").join(F.broadcast(found), ["term", "phrase", "first"]).select("term", "before", "word", "after", "n").distinct()
    excused = {r["term"]: r["n"] for r in covered.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sorted(tuple(r) for r in found.collect()), excused


def toxicity_scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score`` of every whole text."""
    dense = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _densities(lexicon), "doc_id long, density double"
    )
    logit = F.col("density") * F.lit(lexicon.slope) + F.lit(lexicon.intercept)
    return dense.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Toxicity of each document: ``doc_id, held_out, score, predicted``.

    ``score`` lies between 0 and 1 and is higher where label 1 is likelier; ``predicted`` is 1 from the
    threshold on. Null and empty texts match nothing and get the lowest score. Repeated rows and null ids
    are scored like any other row, equal texts alike, and an id teaches once, however often it is repeated; whole texts of any length are matched, and a long one
    needs more terms for the same score; without labelled rows every score is 0.5, and an empty table gives
    no rows. Other columns of the documents are never read, whatever their names.
    """
    scored = toxicity_scores(docs, learn_lexicon(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores at least ``threshold``; columns are unchanged.

    Null and empty texts match nothing and stay unless a text without terms scores so high; repeated rows go
    or stay together; an empty table stays empty.
    """
    schema = docs.schema
    place = docs.columns.index("text")
    slope, intercept = lexicon.slope, lexicon.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in _slices(batches):
            dense = np.array([_density_of(automaton, fold(text)) for text in batch.column(place).to_pylist()], dtype=float)
            score = 1 / (1 + np.exp(-np.clip(dense * slope + intercept, -30, 30)))
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, schema)
