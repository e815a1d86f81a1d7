"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, mix, only_row, pick, stage, with_row

#: Documents that the scorer is fitted on at most, its number of weights, and the least score of a good document.
SAMPLE, WEIGHTS, THRESHOLD = 4000, 1 << 16, 0.25

#: Insults; a document with several in few words is rejected whatever its form.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
LEAST_INSULTS, INSULT_SHARE = 2, 1 / 250

#: The first seven only ever vote against a document, the last three either way: at most 2 ** 7 * 3 ** 3 patterns.
LABELLERS = ("symbols", "capitals", "stutter", "runs", "variety", "isolated", "end_marks", "clean_words", "function_words", "pairs")

#: Least accuracy on good documents.
LEAST_ACCURACY = 0.75

#: Documents of fewer words are too short to be judged by their form.
LEAST_WORDS = 8

#: Very common short words of some languages.
FUNCTION_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with you"
    " au avec ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une"
    " auf aus das dem den der die ein eine er es für im ist mit nicht sich sie und von zu"
    " al como con del el ella en es la las lo los no para por que se su un una y"
).split()

LETTER, CAPITAL, DIGIT, MARK, OTHER = range(5)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[ord("a") : ord("z") + 1] = LETTER
KIND[128:] = LETTER
KIND[ord("A") : ord("Z") + 1] = CAPITAL
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[[ord(c) for c in ".,;:'\"-()?"]] = MARK
KIND[32] = 255


def hash_words(words: list[str]) -> np.ndarray:
    return np.unique(plain_words(Words([w.encode() for w in words])))


def per_doc(words: Words, values: np.ndarray) -> np.ndarray:
    """Sum of a word's value over each document."""
    return np.bincount(words.doc, weights=values, minlength=len(words.first) - 1)


def plain_words(words: Words) -> np.ndarray:
    """Hash of each word in lower case without marks around it."""
    data = words.data
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    kind = KIND[data]
    core = (kind == LETTER) | (kind == CAPITAL) | (kind == DIGIT)
    length = words.end - words.start + 1
    power = np.cumprod(np.full(int(length.max(initial=1)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    before = np.cumsum(core) - core
    place = before - np.repeat(before[words.start], length)
    return mix(np.add.reduceat(np.where(core, (lower.astype(np.uint64) + np.uint64(1)) * power[place], np.uint64(0)), words.start))


def shapes(words: Words) -> np.ndarray:
    """Hash of each word's form: runs of letters, capitals and digits as one sign each, marks and symbols as they are."""
    data = words.data
    kind = KIND[data].astype(np.uint64)
    sign = np.where(kind >= MARK, data.astype(np.uint64) + np.uint64(8), kind)
    new = np.ones(len(data), dtype=bool)
    new[1:] = sign[1:] != sign[:-1]
    new[words.start] = True
    length = words.end - words.start + 1
    power = np.cumprod(np.full(int(length.max(initial=1)) + 1, 0xD1342543DE82EF95, dtype=np.uint64))
    before = np.cumsum(new) - new
    place = before - np.repeat(before[words.start], length)
    return mix(np.add.reduceat(np.where(new & (data != 32), (sign + np.uint64(1)) * power[place], np.uint64(0)), words.start))


def measure(words: Words, n_docs: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Shares that labellers look at, by document, and the number of insults."""
    names = ("symbols", "capitals", "stutter", "runs", "variety", "isolated", "ended", "clean", "function", "pairs")
    n = np.maximum(np.diff(words.first), 1).astype(np.float64)
    if not len(words):
        return dict.fromkeys(names, np.zeros(n_docs)), np.zeros(n_docs)
    kind = KIND[words.data]
    count = {k: np.add.reduceat((kind == k).astype(np.float64), words.start) for k in (LETTER, CAPITAL, DIGIT, OTHER)}
    length = (words.end - words.start).astype(np.float64)
    core = count[LETTER] + count[CAPITAL] + count[DIGIT]
    is_core = kind <= DIGIT
    ends_twice = ~is_core[words.end - 1] & ~is_core[np.maximum(words.end - 2, words.start)]
    plain = plain_words(words)
    again = np.zeros(len(words))
    again[1:] = (plain[1:] == plain[:-1]) & (words.doc[1:] == words.doc[:-1])
    # How often in a row a word has been said, and one row for each document and distinct word or pair.
    at = np.arange(len(words))
    run = at - np.maximum.accumulate(np.where(again == 0, at, 0)) + 1
    own = mix(words.doc.astype(np.uint64))
    first = np.unique(own ^ plain, return_index=True)[1]
    pair = np.unique(own[1:] ^ mix(plain[:-1] * np.uint64(3) + plain[1:]), return_index=True)[1] + 1
    shares = (
        per_doc(words, count[OTHER]) / np.maximum(per_doc(words, length), 1),
        per_doc(words, count[CAPITAL]) / np.maximum(per_doc(words, count[LETTER] + count[CAPITAL]), 1),
        per_doc(words, again) / n,
        per_doc(words, run == 4) / n,
        np.bincount(words.doc[first], minlength=n_docs) / n,
        per_doc(words, core == 0) / n,
        per_doc(words, (core > 0) & ends_twice) / n,
        per_doc(words, (core > 0) & (length - core <= 1)) / n,
        per_doc(words, np.isin(plain, _FUNCTION)) / n,
        np.bincount(words.doc[pair], minlength=n_docs) / n,
    )
    return dict(zip(names, shares, strict=True)), per_doc(words, np.isin(plain, _INSULTS))


def vote(shares: dict[str, np.ndarray], n_words: np.ndarray) -> np.ndarray:
    """Votes of LABELLERS: 1 good, -1 bad, 0 none. Most abstain on texts of a few words."""
    some, short = n_words >= LEAST_WORDS, n_words < 2000

    def say(bad: np.ndarray, good: np.ndarray | bool = False, asked: np.ndarray = some) -> np.ndarray:
        return ((good & asked).astype(np.int8)) - (bad & asked)

    return np.stack([
        say(shares["symbols"] > 0.05),
        say(shares["capitals"] > 0.5),
        say(shares["stutter"] > 0.25),
        say(shares["runs"] > 0.01),
        say(shares["variety"] < 0.15, asked=some & short),
        say(shares["isolated"] > 0.2),
        say(shares["ended"] > 0.3),
        say(shares["clean"] < 0.7, shares["clean"] > 0.9),
        say(shares["function"] < 0.02, shares["function"] > 0.1, n_words >= 40),
        say(shares["pairs"] < 0.4, shares["pairs"] > 0.6),
    ])


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signs = np.array(["-", "0", "+"])
    for batch, texts in chunks(batches):
        words = Words(texts)
        n = np.diff(words.first)
        shares, insults = measure(words, len(texts))
        said = vote(shares, n)
        patterns = ["".join(row) for row in signs[said.T + 1]]
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id"),
            "version": batch.column("version"),
            "votes": pa.array(patterns, pa.string()),
            "long_enough": pa.array(n >= LEAST_WORDS),
            "insulting": pa.array((insults >= LEAST_INSULTS) & (insults >= INSULT_SHARE * n)),
        })


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of a good document for each pattern of votes, and each labeller's accuracy.

    Expectation-maximisation of a model in which labellers that vote err independently; row 0 of the accuracies is
    for good, row 1 for bad documents. A labeller without votes keeps its start. Starting better than chance
    settles which class is the good one; one imagined vote a labeller and class keeps accuracies inside (0, 1). On
    good documents a labeller is taken to be right at least LEAST_ACCURACY of the time: else those that only vote
    against rare kinds of junk would be explained away.
    """
    names = sorted(patterns)
    if not names:
        return {}, np.full((2, 0), 0.5)
    count = np.array([patterns[n] for n in names], dtype=np.float64)
    said = np.array([[{"-": -1, "0": 0, "+": 1}[c] for c in n] for n in names])
    accuracy, share = np.full((2, said.shape[1]), 0.8), 0.7
    for _ in range(rounds):
        good = np.log(share) + (said > 0) @ np.log(accuracy[0]) + (said < 0) @ np.log(1 - accuracy[0])
        bad = np.log(1 - share) + (said < 0) @ np.log(accuracy[1]) + (said > 0) @ np.log(1 - accuracy[1])
        posterior = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        weight = count * posterior, count * (1 - posterior)
        for k, right in enumerate((said > 0, said < 0)):
            accuracy[k] = (weight[k] @ right + 0.8) / (weight[k] @ (said != 0) + 1)
        accuracy[0] = np.maximum(accuracy[0], LEAST_ACCURACY)
        share = (weight[0].sum() + 1) / (count.sum() + 2)
    return dict(zip(names, posterior.tolist(), strict=True)), accuracy


def features(words: Words) -> np.ndarray:
    """Hashed features of each word, one row for each kind: form, form after form, and word."""
    shape = shapes(words)
    plain = plain_words(words)
    before = np.zeros_like(shape)
    same = np.zeros(len(shape), dtype=np.uint64)
    inside = words.doc[1:] == words.doc[:-1]
    before[1:] = np.where(inside, shape[:-1], 0)
    same[1:] = inside & (plain[1:] == plain[:-1])
    pair = mix(before * np.uint64(3) + shape * np.uint64(5) + same)
    return (np.stack([shape, pair, mix(plain + np.uint64(7))]) % np.uint64(WEIGHTS)).astype(np.int64)


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each document with their shares of its words."""
    for batch, texts in chunks(batches):
        words = Words(texts)
        n = np.diff(words.first)
        places, shares = [np.zeros(0, np.int64)] * len(texts), [np.zeros(0)] * len(texts)
        if len(words):
            hashed = features(words)
            for i in range(len(texts)):
                if n[i]:
                    index, count = np.unique(hashed[:, words.first[i] : words.first[i + 1]], return_counts=True)
                    places[i], shares[i] = index, count / n[i]
        yield pa.RecordBatch.from_pydict({
            "posterior": batch.column("posterior"),
            "places": pa.array(places, pa.list_(pa.int32())),
            "shares": pa.array(shares, pa.list_(pa.float32())),
        })


def fit(rows: list, rounds: int = 150, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression on soft labels, by gradient descent with momentum."""
    weights, offset = np.zeros(WEIGHTS), 0.0
    if not rows:
        return weights, offset
    label = np.array([r["posterior"] for r in rows])
    size = np.array([len(r["places"]) for r in rows])
    place = np.concatenate([np.array(r["places"], dtype=np.int64) for r in rows])
    share = np.concatenate([np.array(r["shares"], dtype=np.float64) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    # Both classes weigh the same.
    balance = np.where(label > 0.5, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    speed, turn = np.zeros(WEIGHTS), 0.0
    for _ in range(rounds):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=share * weights[place], minlength=len(rows)) + offset, -30, 30)))
        error = (score - label) * balance
        speed = 0.9 * speed - rate * (np.bincount(place, weights=share * error[row], minlength=WEIGHTS) + decay * weights)
        turn = 0.9 * turn - rate * error.sum()
        weights, offset = weights + speed, offset + turn
    return weights, offset


def scores(batches: Iterator[pa.RecordBatch], weights: np.ndarray, offset: float) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        words = Words(texts)
        n = np.maximum(np.diff(words.first), 1)
        total = per_doc(words, weights[features(words)].sum(axis=0)) if len(words) else np.zeros(len(texts))
        score = 1 / (1 + np.exp(-np.clip(total / n + offset, -30, 30)))
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "version": batch.column("version"), "score": pa.array(score)})


_FUNCTION, _INSULTS = hash_words(FUNCTION_WORDS), hash_words(list(INSULTS))


def classify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """A row for each id and text of `docs`: id, version (hash of the text), votes, posterior, score, insulting, good.

    LABELLERS vote on each document from simple shares (symbols, capitals, repeated words, ...), or abstain.
    The numbers of their vote patterns over all documents (see LABELLERS) give their accuracies by
    expectation-maximisation and each pattern a posterior. Those are the labels that a linear scorer over hashed
    word forms and words is fitted to, on the `sample` documents of the smallest hashes (the one bound here; votes,
    accuracies and scores cover all rows). good: a score of at least `threshold`, or fewer
    than LEAST_WORDS words, and not insulting, which a list of words decides.

    Null and empty texts have no words and no votes; like other short ones they aren't rejected. A null id is an id like any other. Rows that repeat id and text give one row. An
    empty table gives an empty result. Further columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("version", F.xxhash64("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    said = stage(rows.mapInArrow(votes, f"id {id_type}, version long, votes string, long_enough boolean, insulting boolean").distinct())
    patterns = {r["votes"]: r["count"] for r in said.groupBy("votes").count().collect()}
    posterior, _ = estimate(patterns)
    spark = docs.sparkSession
    # A row for each pattern; see LABELLERS for how many there can be.
    known = F.broadcast(spark.createDataFrame(list(posterior.items()), "votes string, posterior double"))
    said = said.join(known, "votes")
    chosen = stage(said.orderBy(F.xxhash64("id", "version"), "id").limit(sample).select("id", "version", "posterior"))
    picked = rows.alias("r").join(
        F.broadcast(chosen.alias("c")), F.col("r.id").eqNullSafe(F.col("c.id")) & (F.col("r.version") == F.col("c.version"))
    )
    fitted = picked.select("r.text", "posterior").mapInArrow(sample_features, "posterior double, places array<int>, shares array<float>")
    weights, offset = fit(sorted(fitted.collect(), key=lambda r: (r["posterior"], r["places"], r["shares"])))
    scored = rows.mapInArrow(lambda batches: scores(batches, weights, offset), f"id {id_type}, version long, score double").distinct()
    a, b = said.alias("a"), scored.alias("b")
    both = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.version") == F.col("b.version")))
    good = ((F.col("score") >= threshold) | ~F.col("long_enough")) & ~F.col("insulting")
    return both.select("a.id", "a.version", "votes", "posterior", "score", "insulting", good.alias("good"))


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The rows of `docs` that `classify` calls good."""
    bad = classify(docs, id_col, text_col, **options).filter("not good").select("id", "version")
    rows = with_row(docs, id=id_col, text=text_col).withColumn("version", F.xxhash64("text"))
    kept = rows.alias("r").join(bad.alias("b"), F.col("r.id").eqNullSafe(F.col("b.id")) & (F.col("r.version") == F.col("b.version")), "left_anti")
    return only_row(kept, docs.columns)
