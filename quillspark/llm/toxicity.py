"""Toxicity scores by weak supervision.

1. Lexicon and patterns: over labelled training rows Spark counts, for each word and each word prefix, the toxic and
   the other documents that hold it once, twice or four times at least. Entries whose counts differ between the classes
   by enough (a likelihood ratio test, ``SIGNIFICANT`` and ``FEATURE_EFFECT``) are features. The strongest on either side become voters,
   for toxic or for clean, beside pattern voters on the number of different toxic entries found.
2. Style voters look at no lexicon: shouting, exclaiming, repeating one word, being brief. They come from no label.
3. Label model: a latent class model over all voters is fitted by EM on labelled and unlabelled texts. A given label is
   one more voter, whose accuracy is estimated, and says nothing about an unlabelled text. The model gives how often each
   voter fires for either class. Voters that fire together within a class say one thing many times: their pairwise
   correlations given the class are estimated and each voter's evidence is divided by the number that it stands for.
   The votes of all unlabelled texts are aggregated by Spark to patterns with counts, and each round sums what it needs
   over them, in integers, so that neither the number of texts nor their order matters. Together they count as a share
   (``UNLABELLED_SHARE``) of the labelled ones, at every size.
4. Classifier: a logistic regression on the presence of words, prefixes and patterns is trained on the posterior labels of
   the labelled texts and scores every whole text.

Bounds: features, voters and classifier are fitted on at most about ``MAX_LABELLED`` labelled ids, chosen by a hash of their
id over the whole table, none of them held out; their feature hits, and sums of the size of the voters squared, are all that
reaches the driver. Features and voters have no number set, only tests that they must pass. Unlabelled texts and texts to
be scored have no bound.

Defined cases: null and empty texts have no features and score the bare intercept; rows with null ids are never
trained on; null labels and labels without document are ignored; an id with several labels takes the one that more of
them give, and none at a tie; documents that repeat an id count once in training (the smallest text) and are all scored;
an empty table gives an empty result; without labelled rows of both classes every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import stored, unstore

MAX_LABELLED, MIN_SUPPORT = 12_000, 4
#: Least likelihood ratio (chi-squared, one degree of freedom) of a feature and of a voter: against chance, one in twenty
#: and one in a thousand, and for each labelled row, so that more rows don't let in ever weaker entries.
SIGNIFICANT, TELLING, FEATURE_EFFECT, VOTER_EFFECT = 3.84, 10.83, 0.0025, 0.005
#: Log odds that a voter has at least, for toxic or for clean.
TOXIC_ODDS, CLEAN_ODDS = 2.0, -0.5
#: What all texts without label count for together, as a share of those with.
UNLABELLED_SHARE = 0.1
#: Posteriors of unlabelled texts are summed in integers of this fraction.
STEPS = 1 << 20
#: Patterns of votes that are multiplied at once.
VOTE_BLOCK = 1024
#: Prefixes of these lengths are patterns of their own. Longer words than this are not remembered between texts.
PREFIXES, CACHED_CHARS = (3, 4, 5, 6, 7, 8), 48
WORDS = re.compile(r"[^\W\d_]+")
TIMES = (1, 2, 4)
HIT_PATTERNS = (1, 2, 4)
STYLES = ("shouts", "exclaims", "repeats", "brief")
CACHED_WORDS = 200_000
#: Documents with this score or more are predicted toxic.
REJECTED = 0.5


def stems_of(word: str) -> list[str]:
    """The word itself and its prefixes."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def features_of(text: str | None) -> list[tuple[str, int]]:
    """(stem, least number of times) for all that hold."""
    stems: Counter[str] = Counter()
    for word, n in Counter(WORDS.findall((text or "").lower())).items():
        for stem in stems_of(word):
            stems[stem] += n
    return [(stem, least) for stem, n in stems.items() for least in TIMES if n >= least]


def styles_of(text: str | None, words: Counter[str]) -> list[int]:
    """Places in ``STYLES`` of what holds: three of ten letters A-Z capital, three exclamation marks, one word in five, under 30 words."""
    text, total = text or "", words.total()
    signs = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    capitals, small = (np.count_nonzero((signs >= a) & (signs <= a + 25)) for a in b"Aa")
    told = (capitals + small >= 20 and capitals >= 0.3 * (capitals + small), text.count("!") >= 3, total >= 10 and max(words.values()) >= 0.2 * total, 0 < total < 30)
    return [k for k, holds in enumerate(told) if holds]


def crc_bucket(column: str):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, text) of the labelled rows to learn from, none of them held out, each id once."""
    told = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_bucket("doc_id") != 0))
    known = told.groupBy("doc_id").agg(F.avg("toxic").alias("share")).filter("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("label"))
    chosen = stored(known.filter(drawn("label", MAX_LABELLED / max(1, known.count()))))  # MAX_LABELLED rows or so
    usable = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (crc_bucket("doc_id") != 0))
    rows = stored(usable.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text"))
    unstore(chosen)
    return rows


def unlabelled_patterns(documents: DataFrame, labels: DataFrame, model: ToxicityModel) -> DataFrame:
    """(votes, n): what fires in the texts without any label, none of them held out, and how many texts there are of each.

    Ids and votes alone meet the labels; an id that several rows bear counts with the smallest of its votes.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.features, model.lexicon, model.voters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, lexicon, voters = shared.value
        local, place = ToxicityModel(features, lexicon, np.zeros(0), 0.0), {k: v for v, k in enumerate(voters)}
        for batch in batches:
            votes = [sorted(place[k] for k in local.hits(t).tolist() if k in place) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, type=pa.list_(pa.int32()))], names=["doc_id", "votes"])

    usable = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & (crc_bucket("doc_id") != 0))
    voted = usable.mapInArrow(run, "doc_id long, votes array<int>")
    others = voted.join(labels.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_anti")
    return others.groupBy("doc_id").agg(F.min("votes").alias("votes")).groupBy("votes").agg(F.count("*").alias("n"))


def firing_together(patterns: DataFrame, n_voters: int) -> DataFrame:
    """(voter, counts): the texts in which a voter fires beside each other one, as 64-bit integers by voter.

    A task multiplies the votes that it reads, block by block, and sends on one row for each of its voters.
    """

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n_voters, n_voters), dtype=np.int64)
        for batch in batches:
            for block in (batch.slice(k, VOTE_BLOCK) for k in range(0, batch.num_rows, VOTE_BLOCK)):
                votes, n = block.column(0), block.column(1).to_numpy()
                fired = np.zeros((len(n), n_voters))
                fired[np.repeat(np.arange(len(n)), np.diff(votes.offsets.to_numpy())), votes.flatten().to_numpy()] = 1
                counts += np.rint((fired * n[:, None]).T @ fired).astype(np.int64)  # exact below 2^53 texts
        yield told({int(k): counts[k] for k in np.flatnonzero(np.diag(counts))})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for voter, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[voter] = sums.get(voter, 0) + np.frombuffer(counts, dtype=np.int64)
        yield told(sums)

    def told(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["voter", "counts"])

    kind = "voter int, counts binary"
    return patterns.select("votes", "n").mapInArrow(multiplied, kind).repartition("voter").mapInArrow(summed, kind)


class Unlabelled:
    """Sums over the patterns of unlabelled texts, made on the executors; ``weight`` is that of one text."""

    def __init__(self, patterns: DataFrame, n_voters: int, n_labelled: int):
        self.patterns, self.n_voters = patterns, n_voters
        total = patterns.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.weight = UNLABELLED_SHARE * n_labelled / max(total, n_labelled)
        self.total = total
        self.together = np.zeros((n_voters, n_voters))
        for row in firing_together(patterns, n_voters).toLocalIterator():  # the number of voters squared in all
            self.together[row["voter"]] = np.frombuffer(row["counts"], dtype=np.int64) * self.weight

    def sums(self, model: LabelModel) -> tuple[float, np.ndarray]:
        """(mass, firings of each voter) of the toxic class; those of the clean one are the rest."""
        if not self.total:
            return 0.0, np.zeros(self.n_voters)
        weight, base = model.evidence()
        shared = self.patterns.sparkSession.sparkContext.broadcast((weight, base))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, base = shared.value
            total = np.zeros(len(weight) + 1, dtype=np.int64)
            for batch in batches:
                votes, n = batch.column(0), batch.column(1).to_numpy()
                fired = votes.flatten().to_numpy()
                lane = np.repeat(np.arange(len(n)), np.diff(votes.offsets.to_numpy()))
                logit = base + np.bincount(lane, weights=weight[fired], minlength=len(n))
                mass = np.rint(STEPS / (1 + np.exp(-np.clip(logit, -30, 30)))).astype(np.int64) * n
                total[-1] += mass.sum()
                np.add.at(total, fired, mass[lane])
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(total[slots], pa.int64())], names=["slot", "mass"])

        out = np.zeros(self.n_voters + 1)
        for row in self.patterns.select("votes", "n").mapInArrow(run, "slot int, mass long").groupBy("slot").agg(F.sum("mass").alias("mass")).collect():  # a row for each voter
            out[row["slot"]] = row["mass"] / STEPS * self.weight
        return float(out[-1]), out[:-1]


def drawn(purpose: str, share: float) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(f"toxicity {purpose}")), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)


def class_counts(rows: DataFrame) -> DataFrame:
    """(stem, times, toxic, clean): documents of either class that hold the stem so many times at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                counts[label].update(features_of(text))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield _counted(counts)
                counts = (Counter(), Counter())
        yield _counted(counts)

    kind = T.StructType([T.StructField("stem", T.StringType()), T.StructField("times", T.IntegerType()), T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType())])
    parts = rows.select("label", "text").mapInArrow(run, kind)
    return parts.groupBy("stem", "times").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"))


def significance(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Likelihood ratio of the counts of either class against one rate for both."""
    rate = (toxic + clean) / float(n_toxic + n_clean)

    def part(count: Column, of: int) -> Column:
        held = F.when(count > 0, count * F.log(count / (rate * of))).otherwise(0.0)
        return held + F.when(count < of, (of - count) * F.log((of - count) / ((1 - rate) * of))).otherwise(0.0)

    return 2 * (part(toxic, n_toxic) + part(clean, n_clean))


def without_nested(counts: dict[tuple[str, int], tuple[int, int]]) -> list[tuple[str, int]]:
    """The entries but those within a shorter prefix that the same numbers of documents hold, hence the same documents."""
    return [(stem, times) for (stem, times), n in counts.items() if not any(counts.get((f"{stem[:k]}*", times)) == n for k in PREFIXES if len(stem.rstrip("*")) > k)]


def _counted(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    rows = [(*f, label, n) for label in (0, 1) for f, n in counts[label].items()]
    names = ["stem", "times", "label", "n"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(kinds)], names=names)


@dataclass
class ToxicityModel:
    """Features by index; ``lexicon``, the toxic entries, are counted for the hit patterns, whose indices follow, then the styles."""

    features: dict[tuple[str, int], int]
    lexicon: frozenset[int]
    weights: np.ndarray
    intercept: float
    label_model: LabelModel | None = None
    voters: list[int] = field(default_factory=list)

    def __post_init__(self):
        stems = {stem: k for k, stem in enumerate(dict.fromkeys(stem for stem, _ in self.features))}
        self.stems, self.steps = stems, [[] for _ in stems]
        for (stem, least), k in self.features.items():
            self.steps[stems[stem]].append((least, k))
        self.cache: dict[str, tuple[int, ...]] = {}

    def hits(self, text: str | None) -> np.ndarray:
        """Indices of the features that a text holds, the patterns after them."""
        times: Counter[int] = Counter()
        cache = self.cache
        words = Counter(WORDS.findall((text or "").lower()))
        for word, n in words.items():
            known = cache.get(word)
            if known is None:
                known = tuple(k for k in map(self.stems.get, stems_of(word)) if k is not None)
                if len(word) <= CACHED_CHARS:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[word] = known
            for stem in known:
                times[stem] += n
        found = {k for stem, n in times.items() for least, k in self.steps[stem] if n >= least}
        entries = len(found & self.lexicon)
        patterns = [k for k, least in enumerate(HIT_PATTERNS) if entries >= least] + [len(HIT_PATTERNS) + k for k in styles_of(text, words)]
        return np.array([*sorted(found), *(len(self.features) + k for k in patterns)], dtype=np.int32)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[self.hits(text)].sum(), -60, 60))))

    def weak_logit(self, text: str | None) -> float:
        """What the voters alone say of a text, without a given label."""
        return float(self.label_model.logit(np.isin(self.voters, self.hits(text))[None, :])[0])


@dataclass
class LabelModel:
    """Firing rates of each voter by class (2 x voters), the share of its evidence that counts, and the log odds of the classes."""

    rates: np.ndarray
    share: np.ndarray
    prior: float

    def evidence(self) -> tuple[np.ndarray, float]:
        """What each voter that fires adds to the log odds, and the log odds where none does."""
        present = self.share * np.log(self.rates[1] / self.rates[0])
        absent = self.share * np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        return present - absent, self.prior + float(absent.sum())

    def logit(self, votes: np.ndarray) -> np.ndarray:
        weight, base = self.evidence()
        return base + votes @ weight.astype(np.float32)


def shares(moment: np.ndarray, mass: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """1 over the number of voters that each stands for, by correlations within the classes.

    ``moment``: the weight of the texts in which two voters fire, of either class.
    """
    within = moment - sum(m * np.outer(r, r) for m, r in zip(mass, rates, strict=True))
    scale = np.sqrt(np.maximum(np.diag(within), 1e-9 * mass.sum()))
    correlation = np.clip(within / np.outer(scale, scale), 0, 1)
    np.fill_diagonal(correlation, 1)
    return 1 / np.where(correlation > 0.1, correlation, 0).sum(axis=1)


def fit_label_model(votes: np.ndarray, given: np.ndarray, unlabelled: Unlabelled | None = None, rounds: int = 25) -> tuple[np.ndarray, LabelModel]:
    """Posterior of each labelled row, its given label a vote among the others, and the model of the other voters.

    votes: rows x voters, 0 or 1, as float32; given: 1 or 0. Unlabelled texts enter once these have given first rates.
    """
    posterior = np.where(given > 0, 0.95, 0.05)
    moment = votes.T.astype(np.float64) @ votes
    model = None
    for step in range(rounds):
        p1, p0 = posterior.astype(np.float32), (1 - posterior).astype(np.float32)
        mass, fired = np.array([p0.sum(), p1.sum()], dtype=np.float64), np.vstack([p0 @ votes, p1 @ votes]).astype(np.float64)
        together = moment
        if model is not None and unlabelled is not None:
            toxic, firings = unlabelled.sums(model)
            mass += [unlabelled.total * unlabelled.weight - toxic, toxic]
            fired += [np.diag(unlabelled.together) - firings, firings]
            together = moment + unlabelled.together
        rates = (fired + 0.5) / (mass[:, None] + 5)
        if step % 5 == 0:  # correlations change little from round to round
            share = shares(together, mass, rates)
        model = LabelModel(rates, share, float(np.log((mass[1] + 1) / (mass[0] + 1))))
        right = np.array([(p0 @ (given == 0) + 5) / (p0.sum() + 6), (p1 @ (given == 1) + 5) / (p1.sum() + 6)])
        label = np.where(given > 0, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
        updated = 1 / (1 + np.exp(-np.clip(model.logit(votes) + label, -30, 30)))
        settled = step > 1 and np.abs(updated - posterior).max() < 1e-4
        posterior = updated
        if settled:
            break
    return posterior, model


def fit_classifier(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, weight: np.ndarray, n_features: int, penalty: float = 0.5, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression on the features at (rows, columns) and soft labels of weighted rows; ``penalty`` is on the squared weights.

    Newton's method; each step is solved by conjugate gradients, so that only the hits are held.
    """
    n = len(target)
    ridge = np.r_[np.full(n_features, penalty), 1e-3]

    def apply(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=w[columns], minlength=n) + w[-1]

    def gathered(v: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(columns, weights=v[rows], minlength=n_features), v.sum()]

    w = np.zeros(n_features + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(apply(w), -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-4) * weight
        scale = gathered(curve) + ridge  # the diagonal, as features are 0 or 1
        residual = -(gathered((p - target) * weight) + ridge * w)
        step, direction, size = np.zeros_like(w), residual / scale, float(residual @ (residual / scale))
        enough = 1e-10 * size
        for _ in range(200):
            if size <= enough:
                break
            image = gathered(curve * apply(direction)) + ridge * direction
            length = size / float(direction @ image)
            step += length * direction
            residual = residual - length * image
            before, size = size, float(residual @ (residual / scale))
            direction = residual / scale + size / before * direction
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    rows = training_rows(documents, labels)
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return ToxicityModel({}, frozenset(), np.zeros(len(HIT_PATTERNS) + len(STYLES)), -60.0)
    n_labelled = totals[0] + totals[1]
    counts = class_counts(rows).filter(F.col("toxic") + F.col("clean") >= MIN_SUPPORT)
    told = counts.withColumn("g", significance(F.col("toxic"), F.col("clean"), totals[1], totals[0])).filter(F.col("g") >= max(SIGNIFICANT, FEATURE_EFFECT * n_labelled))
    passed = {(r["stem"], r["times"]): r for r in told.orderBy("stem", "times").collect()}
    names = without_nested({k: (r["toxic"], r["clean"]) for k, r in passed.items()})
    odds = [np.log((passed[f]["toxic"] + 0.5) / (totals[1] + 1)) - np.log((passed[f]["clean"] + 0.5) / (totals[0] + 1)) for f in names]
    toxic = [k for k, f in enumerate(names) if odds[k] >= TOXIC_ODDS]
    telling = [k for k, f in enumerate(names) if passed[f]["g"] >= max(TELLING, VOTER_EFFECT * n_labelled) and (odds[k] >= TOXIC_ODDS or odds[k] <= CLEAN_ODDS)]
    model = ToxicityModel({f: k for k, f in enumerate(names)}, frozenset(toxic), np.zeros(len(names) + len(HIT_PATTERNS) + len(STYLES)), 0.0)
    shared = documents.sparkSession.sparkContext.broadcast((model.features, model.lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, lexicon = shared.value
        local = ToxicityModel(features, lexicon, np.zeros(0), 0.0)
        for batch in batches:
            found = [local.hits(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, type=pa.list_(pa.int32()))], names=["label", "key", "hits"])

    table = rows.select("label", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "label int, key long, hits array<int>").toArrow()
    unstore(rows)
    # in an order of its own, so that reruns add up the same numbers alike
    table = table.sort_by([("label", "ascending"), ("key", "ascending")]).combine_chunks()
    given, hits = table.column("label").to_numpy(), table.column("hits").chunk(0)
    at = np.repeat(np.arange(len(given)), np.diff(hits.offsets.to_numpy()))
    held = hits.flatten().to_numpy()
    model.voters = [*telling, *range(len(names), len(model.weights))]
    place = np.full(len(model.weights), -1)
    place[model.voters] = np.arange(len(model.voters))
    votes = np.zeros((len(given), len(model.voters)), dtype=np.float32)
    votes[at[place[held] >= 0], place[held][place[held] >= 0]] = 1
    patterns = stored(unlabelled_patterns(documents, labels, model))
    posterior, model.label_model = fit_label_model(votes, given, Unlabelled(patterns, len(model.voters), len(given)))
    unstore(patterns)
    model.weights, model.intercept = fit_classifier(at, held, posterior, np.ones(len(given)), len(model.weights))
    return model


def score_documents(documents: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """The documents with a score in ``column`` (replaced if there is one), made from every whole text."""
    documents = documents.drop(column)
    shared = documents.sparkSession.sparkContext.broadcast((model.features, model.lexicon, model.weights, model.intercept))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = ToxicityModel(*shared.value)
        for batch in batches:
            scores = [local.score(t) for t in batch.column(at).to_pylist()]
            yield batch.append_column(column, pa.array(scores, type=pa.float64()))

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(column, T.DoubleType())]))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their own columns, that the classifier doesn't predict toxic."""
    column = f"_{uuid.uuid4().hex}"
    return score_documents(documents, fit(documents, labels), column).filter(F.col(column) < REJECTED).drop(column)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score_documents(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", (crc_bucket("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= REJECTED).cast("int").alias("predicted"))
