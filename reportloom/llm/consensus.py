"""Consensus of several annotators by a community confusion model.

Each annotator belongs to one of a few communities, each community shares one confusion
matrix. Variational updates alternate between the true labels of the items, the community
of each annotator and the Dirichlet posteriors of the matrices, until the matrices settle.

The prior of the matrices weighs as much as all labels given, and how often a label occurs is
no evidence for it. Otherwise the model confirms itself: on the test data the matrix of a
weak annotator then takes up the labels that the others give, and a frequent label overrules
two votes against one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.session import Scratch

#: The labels of each kind, and what marks each in free spelling; the earliest mark counts.
LABELS: dict[str, dict[str, str]] = {
    "extraction": {"TP": r"\bt\.? ?p\b|true[ _-]*pos", "FP": r"\bf\.? ?p\b|false[ _-]*pos"},
    "attribution": {"unattributed": r"un-?attribut|not[ _-]+attribut|neither", "retrieval": r"retriev", "input": r"\binput"},
}
#: Diagonal of each community's matrix in the prior.
COMMUNITIES = (0.9, 0.7)
#: Weight of the prior: labels per label given, over all communities and true labels.
PRIOR_SHARE = 1.0
#: Labels by which an annotator's reliability leans on the communities, and least weight of a row of the prior.
PRIOR_LABELS = 12.0
#: Vote patterns that the matrices are fitted on, the most frequent first; each counts as often as it occurs.
PATTERNS = 20_000
#: The matrices have settled when no chance moves more than this; far more updates than that ever takes raise an error.
SETTLED, MOST_UPDATES = 1e-6, 10_000

VOTES = "array<struct<annotator:string,label:string>>"
MOST = max(map(len, LABELS.values()))
M = len(COMMUNITIES)


def label_of(kind: str, raw: Column) -> Column:
    """The label meant by a free spelling, or null if it is none."""
    text = F.regexp_replace(F.lower(raw), "_", " ")
    names = LABELS[kind]
    first = F.regexp_extract(text, "|".join(names.values()), 0)
    out = F.lit(None).cast("string")
    for name, mark in reversed(names.items()):
        out = F.when(first.rlike(mark), F.lit(name)).otherwise(out)
    return F.when(first != "", out)


def votes(entries: DataFrame) -> DataFrame:
    """(entity_id, label_kind, annotator, label): one vote for each annotator, item and kind.

    ``entries`` has entity_id, annotator, at, and the raw columns extraction and attribution.
    The latest entry that is a label at all counts; a null time is the oldest, of equal times
    the label later in the alphabet counts. Entries without entity or annotator are left out.
    Repeats and revisions are combined before the shuffle.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("label_kind"), label_of(k, F.col(k)).alias("label")) for k in LABELS])
    return (
        entries.where("entity_id is not null and annotator is not null")
        .select("entity_id", "annotator", "at", F.explode(kinds).alias("k"))
        .where("k.label is not null")
        .groupBy("entity_id", F.col("k.label_kind").alias("label_kind"), "annotator")
        .agg(F.max(F.struct("at", "k.label")).alias("r"))
        .select("entity_id", "label_kind", "annotator", F.col("r.label").alias("label"))
    )


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    down = np.zeros_like(x)
    while (x < 8).any():
        down -= np.where(x < 8, 1 / x, 0.0)
        x = np.where(x < 8, x + 1, x)
    y = 1 / (x * x)
    return down + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def _expected_logs(alpha: np.ndarray) -> np.ndarray:
    return _digamma(alpha) - _digamma(alpha.sum(axis=-1, keepdims=True))


def _shares(gains: np.ndarray) -> np.ndarray:
    parts = np.exp(gains - gains.max(axis=-1, keepdims=True))
    return parts / parts.sum(axis=-1, keepdims=True)


@dataclass
class Communities:
    """Dirichlet posteriors: for each kind the communities' matrices (community, true, said) and their sizes."""

    confusion: dict[str, np.ndarray] = field(default_factory=dict)
    sizes: dict[str, np.ndarray] = field(default_factory=dict)
    members: dict[str, dict[str, np.ndarray]] = field(default_factory=dict)

    def fit(self, kind: str, patterns: list[tuple[list[tuple[str, str]], float]]) -> None:
        """Variational updates on vote patterns ((annotator, label) pairs, times it occurs)."""
        names = list(LABELS[kind])
        who = {a: i for i, a in enumerate(sorted({a for p, _ in patterns for a, _ in p}))}
        cell = [(i, who[a], names.index(said), n) for i, (p, n) in enumerate(patterns) for a, said in p]
        item, by, said = (np.array([c[k] for c in cell], np.int64) for k in range(3))
        weight = np.array([c[3] for c in cell], float)
        n = len(names)
        worth = max(PRIOR_LABELS, PRIOR_SHARE * weight.sum() / (M * n))
        prior = np.array([[[worth * (d if i == j else (1 - d) / (n - 1)) for j in range(n)] for i in range(n)] for d in COMMUNITIES])
        confusion, sizes, members = prior, np.ones(M), np.full((len(who), M), 1 / M)
        for _ in range(MOST_UPDATES):
            logs = _expected_logs(confusion)
            gains = np.zeros((len(patterns), n))
            np.add.at(gains, item, np.einsum("vm,mtv->vt", members[by], logs[:, :, said]))
            true = _shares(gains)
            counts = np.zeros((len(who), n, n))  # annotator, true, said
            np.add.at(counts, (by, slice(None), said), weight[:, None] * true[item])
            members = _shares(np.einsum("ats,mts->am", counts, logs) + _expected_logs(sizes))
            following = prior + np.einsum("am,ats->mts", members, counts)
            sizes = 1.0 + members.sum(axis=0)
            moved = np.abs(following / following.sum(-1, keepdims=True) - confusion / confusion.sum(-1, keepdims=True)).max()
            confusion = following
            if moved < SETTLED:
                break
        else:
            raise RuntimeError("the confusion matrices did not settle")
        self.confusion[kind], self.sizes[kind] = confusion, sizes
        self.members[kind] = {a: members[i] for a, i in who.items()}

    def logs(self) -> Column:
        """Expected logs of a vote: what each community says of it for each true label, by community and label."""
        rows = []
        for k, names in LABELS.items():
            by = _expected_logs(self.confusion[k])
            for said, name in enumerate(names):
                values = [float(by[m][j][said]) if j < len(names) else 0.0 for m in range(M) for j in range(MOST)]
                rows += [F.lit(f"{k}|{name}"), F.array(*map(F.lit, values))]
        return F.element_at(F.create_map(*rows), F.concat_ws("|", "label_kind", "label"))

    def of_kind(self, values: dict[str, list[float]]) -> Column:
        """An array for each kind."""
        rows = []
        for k, v in values.items():
            rows += [F.lit(k), F.array(*[F.lit(float(x)) for x in v])]
        return F.element_at(F.create_map(*rows), F.col("label_kind"))

    def size_logs(self) -> Column:
        return self.of_kind({k: list(_expected_logs(v)) for k, v in self.sizes.items()})

    def accuracies(self) -> Column:
        """Mean chance of each community to say the true label."""
        return self.of_kind({k: [float(np.mean(np.diag(m) / m.sum(axis=1))) for m in self.confusion[k]] for k in LABELS})


def _softmax(columns: list[Column]) -> list[Column]:
    top = F.greatest(*columns)
    parts = [F.exp(c - top) for c in columns]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def _memberships(counts: DataFrame, model: Communities) -> DataFrame:
    """(label_kind, annotator, r0, r1, ...): chance of each community, from expected confusion counts."""
    sums = [F.sum(sum((F.col(f"s{j}") * F.col("_l")[m * MOST + j] for j in range(MOST)), F.lit(0.0))).alias(f"e{m}") for m in range(M)]
    per = counts.withColumn("_l", model.logs()).groupBy("label_kind", "annotator").agg(*sums).withColumn("_s", model.size_logs())
    chance = _softmax([F.col(f"e{m}") + F.col("_s")[m] for m in range(M)])
    return per.select("label_kind", "annotator", *[c.alias(f"r{m}") for m, c in enumerate(chance)])


def _posteriors(votes_of: DataFrame, model: Communities) -> DataFrame:
    """(label_kind, pattern, q0, q1, ...): chance of each label to be the true one, from votes with their annotator's memberships."""
    gains = [F.sum(sum((F.col(f"r{m}") * F.col("_l")[m * MOST + j] for m in range(M)), F.lit(0.0))).alias(f"g{j}") for j in range(MOST)]
    per = votes_of.withColumn("_l", model.logs()).groupBy("label_kind", "pattern").agg(*gains)
    possible = F.element_at(F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, len(v))]), F.col("label_kind"))
    chance = _softmax([F.when(F.lit(j) < possible, F.col(f"g{j}")).otherwise(-1e9) for j in range(MOST)])
    return per.select("label_kind", "pattern", *[c.alias(f"q{j}") for j, c in enumerate(chance)])


def _says(name: Column) -> Callable[[Column], Column]:
    """Whether a vote is for ``name``."""
    return lambda v: v.label == name


@dataclass
class Fitted:
    items: DataFrame
    chance: DataFrame
    counts: DataFrame
    model: Communities


def fit(cast: DataFrame, scratch: Scratch, patterns: int = PATTERNS) -> Fitted:
    """Fit the model to ``votes``.

    Items with the same votes count as one pattern with a weight, which changes no update. The
    matrices, a few numbers, are fitted on the ``patterns`` most frequent patterns (four
    annotators have 80 and 255 in all); what they then tell of every annotator and every item
    is computed from all votes.
    """
    votes_of = F.array_sort(F.collect_list(F.struct("annotator", "label")))  # one for each annotator of an item
    items = scratch.keep(cast.groupBy("entity_id", "label_kind").agg(F.to_json(votes_of).alias("pattern")))
    weighted = scratch.keep(items.groupBy("label_kind", "pattern").agg(F.count("*").cast("double").alias("n")))
    kind = F.from_json("pattern", VOTES)
    model = Communities()
    top = weighted.orderBy(F.desc("n"), "label_kind", "pattern").limit(patterns).withColumn("votes", kind)
    sample: dict[str, list] = {k: [] for k in LABELS}
    for r in top.collect():  # at most ``patterns`` rows
        sample[r.label_kind].append(([(v.annotator, v.label) for v in r.votes], r.n))
    for k, seen in sample.items():
        model.fit(k, seen)
    rows = weighted.select("label_kind", "pattern", "n", F.explode(kind).alias("v")).select("label_kind", "pattern", "n", "v.*")
    known = scratch.spark.createDataFrame(
        [(k, a, *map(float, r)) for k, of in model.members.items() for a, r in of.items()], ", ".join(["label_kind string", "annotator string", *[f"r{m} double" for m in range(M)]])
    )  # the annotators of the sample
    rows = rows.join(F.broadcast(known), ["label_kind", "annotator"], "left").fillna(1.0 / M, [f"r{m}" for m in range(M)])
    expected = [F.sum(F.col("n") * F.col(f"q{j}")).alias(f"s{j}") for j in range(MOST)]
    counts = rows.join(_posteriors(rows, model), ["label_kind", "pattern"]).groupBy("label_kind", "annotator", "label").agg(*expected)
    every = rows.drop(*[f"r{m}" for m in range(M)]).join(_memberships(counts, model), ["label_kind", "annotator"])
    chance = _posteriors(every, model)
    return Fitted(items, chance, counts, model)


def consensus(fitted: Fitted) -> DataFrame:
    """One row per item and kind: votes, consensus label, the model's label and its chance, agreement.

    ``consensus_label`` is the model's label if it passes the check that it has at least two
    votes and more than any other; else it is null. ``overruled`` tells that another label
    would pass the check, which the model doubts. ``agreement`` is the share of pairs of
    annotators who agree, null for one vote.
    """
    kind = F.col("label_kind")  # all of this is the same for all items with the same votes
    named = []
    for j in range(MOST):
        name = F.lit(None).cast("string")
        for k, names in LABELS.items():
            if j < len(names):
                name = F.when(kind == k, list(names)[j]).otherwise(name)
        got = F.size(F.filter("cast", _says(name)))
        named.append(F.struct(got.alias("votes"), F.col(f"q{j}").alias("chance"), name.alias("label")))
    ranked = F.sort_array(F.filter(F.array(*named), lambda x: x.label.isNotNull()), asc=False)
    by_model = F.array_max(F.transform(ranked, lambda x: F.struct(x.chance.alias("chance"), x.label.alias("label"))))
    n = F.size("cast")
    pairs = F.aggregate(ranked, F.lit(0.0), lambda a, x: a + x.votes * (x.votes - 1))
    rows = fitted.chance.withColumn("cast", F.from_json("pattern", VOTES)).withColumn("ranked", ranked)
    top, second = F.col("ranked")[0], F.col("ranked")[1]
    checked = (top.votes >= 2) & (top.votes > second.votes)
    verdicts = rows.select(
        "label_kind", "pattern", n.alias("votes"),
        F.when(checked & (top.label == by_model.label), by_model.label).alias("consensus_label"), (checked & (top.label != by_model.label)).alias("overruled"),
        by_model.label.alias("model_label"), by_model.chance.alias("model_chance"),
        F.when(n >= 2, pairs / (n * (n - 1))).alias("agreement"),
    )
    return fitted.items.join(verdicts, ["label_kind", "pattern"]).drop("pattern")


def annotators(fitted: Fitted) -> DataFrame:
    """(label_kind, annotator, labels, reliability, community): expected chance to say the true label.

    The annotator's own expected hits are pooled with the prior of the communities it
    probably belongs to, so a few labels move the estimate little.
    """
    members = _memberships(fitted.counts, fitted.model)
    kind, label = F.col("label_kind"), F.col("label")
    hit = F.lit(0.0)
    for k, names in LABELS.items():
        for j, name in enumerate(names):
            hit = F.when((kind == k) & (label == name), F.col(f"s{j}")).otherwise(hit)
    said = sum((F.col(f"s{j}") for j in range(MOST)), F.lit(0.0))
    own = fitted.counts.groupBy("label_kind", "annotator").agg(F.sum(hit).alias("hits"), F.sum(said).alias("labels"))
    base = sum((F.col(f"r{m}") * fitted.model.accuracies()[m] for m in range(M)), F.lit(0.0))
    best = F.array_position(F.array(*[F.col(f"r{m}") for m in range(M)]), F.greatest(*[F.col(f"r{m}") for m in range(M)])) - 1
    return own.join(members, ["label_kind", "annotator"]).select(
        "label_kind", "annotator", F.round("labels").cast("bigint").alias("labels"),
        ((F.col("hits") + PRIOR_LABELS * base) / (F.col("labels") + PRIOR_LABELS)).alias("reliability"),
        best.cast("int").alias("community"),
    )


def agreement(cast: DataFrame) -> DataFrame:
    """(label_kind, items, observed, alpha): pairwise agreement and Krippendorff's alpha of each kind.

    Over items with at least two votes; alpha is null where only one label occurs.
    """
    per = cast.groupBy("entity_id", "label_kind", "label").agg(F.count("*").alias("c"))
    sized = per.withColumn("m", F.sum("c").over(Window.partitionBy("entity_id", "label_kind"))).where("m >= 2")
    by_label = sized.groupBy("label_kind", "label").agg(
        F.sum("c").cast("double").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("same"),
        F.sum(F.col("c") / F.col("m")).alias("items"),
    )
    total = by_label.groupBy("label_kind").agg(
        F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum(F.col("n") * (F.col("n") - 1)).alias("chance"), F.sum("items").alias("items")
    )
    observed = F.col("same") / F.col("n")
    expected = F.col("chance") / (F.col("n") * (F.col("n") - 1))
    return total.select(
        "label_kind", F.round("items").cast("bigint").alias("items"), F.round(observed, 6).alias("observed"),
        F.round(F.when(expected < 1, 1 - (1 - observed) / (1 - expected)), 6).alias("alpha"),
    )
