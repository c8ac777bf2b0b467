"""Mixing sources to target weights by soft membership.

A naive Bayes classifier over hashed words is learned from a labelled table and gives every document a posterior
over domains. Document rates r >= 0 are then fitted so that the expected tokens of each domain,
sum of r * tokens * posterior, meet their targets: least squares, weighted by the inverse of each domain's own
tokens, with a slight pull to rate 1 that makes the solution unique. Projected gradient steps solve it: a step
needs only the domains' residuals, so every iteration is one aggregate of as many sums as there are domains, and a
document's rate is a fold over the residuals so far. Nothing but those sums ever reaches the driver. Steps end when
the targets are met, or when they stay as they are (targets that no rates meet); a fit that did neither after STEPS says
so in a warning with what is missing.

Everything is DataFrame expressions. The classifier learns from at most MAX_TRAIN labelled rows (by hash of the
id); its model has DOMAINS * BUCKETS numbers at most and enters plans as a scalar subquery.

Which rows are labelled is said by a table of ids; the labelled rows' domain stands in a column of the documents
(lang, by default), of which unlabelled rows' values are never used. Texts without words have the prior as their
posterior and no tokens: rate 1, whatever the targets. Null domains are not learned from; domains beyond the DOMAINS
largest count as one, "other"; a target for a domain that has no name of its own raises a ValueError. With no labelled rows
there is one domain and every rate is 1. Each row of the input gives one row; equal rows get equal rates. An empty
table gives an empty result; extra columns take no part, whatever their names.

A text's evidence counts as that of at most EVIDENCE words, which keeps memberships soft: naive Bayes takes words for
independent, and with all of them every posterior would be 0 or 1. It is a set parameter, not fitted.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import by_hash, keep, packed

BUCKETS = 1 << 13
DOMAINS = 32
MAX_TRAIN = 20_000
#: A text's evidence counts as that of at most so many words, which keeps memberships soft.
EVIDENCE = 5
PULL = 1e-4
STEPS = 200
CLOSE = 1e-4
#: Steps that move no domain's tokens by more than this share of the goal have settled.
STILL = 1e-7
#: Without targets, domains get their own tokens to this power.
TEMPER = 0.5


def _slots(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def classifier(docs: DataFrame, labelled: DataFrame, domain: str = "lang", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row: names, log priors, and log likelihoods of every domain's slots one domain after another."""
    ids = by_hash(labelled.where("doc_id IS NOT NULL").select("doc_id").distinct(), max_train, labelled.count(), "doc_id")
    rows = docs.select("doc_id", F.col(domain).cast("string").alias("domain"), "text").where("domain IS NOT NULL").join(F.broadcast(ids), "doc_id", "left_semi")
    counted = rows.select("domain", F.explode(_slots(F.col("text"))).alias("slot")).groupBy("domain", "slot").agg(F.count(F.lit(1)).alias("c"))
    counted = keep(counted, "slots")
    large = counted.groupBy("domain").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "domain").limit(DOMAINS - 1).withColumn("name", F.col("domain"))
    merged = counted.join(F.broadcast(large.select("domain", "name")), "domain", "left").groupBy(F.coalesce("name", F.lit("other")).alias("name"), "slot").agg(F.sum("c").alias("c"))
    total = merged.groupBy("name").agg(F.sum("c").alias("n"))
    grid = total.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1)))).join(merged, ["name", "slot"], "left")
    grid = grid.withColumn("w", F.log((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / (F.col("n") + F.lit(0.1 * BUCKETS))))
    each = grid.groupBy("name", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "w"))), lambda x: x["w"]).alias("w"))
    one = each.agg(F.array_sort(F.collect_list(F.struct("name", "n", "w"))).alias("d"))
    whole = F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    model = one.select(F.transform("d", lambda x: x["name"]).alias("names"), F.transform("d", lambda x: F.log(x["n"] / whole)).alias("prior"), F.flatten(F.transform("d", lambda x: x["w"])).alias("weights"))
    none = F.size("names") == 0
    return keep(model.select(F.when(none, F.array(F.lit("other"))).otherwise(F.col("names")).alias("names"), F.when(none, F.array(F.lit(0.0))).otherwise(F.col("prior")).alias("prior"), F.when(none, F.array_repeat(F.lit(0.0), BUCKETS)).otherwise(F.col("weights")).alias("weights")), "model")


def memberships(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs' rows with tokens (their words) and posterior (over the model's names)."""
    prior, weights = model.select("prior").scalar(), model.select("weights").scalar()
    seen = docs.withColumn("_slots", _slots(F.col("text"))).withColumn("_prior", prior)
    share = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.size("_slots"), F.lit(1)))
    score = F.transform(
        F.sequence(F.lit(0), F.size("_prior") - 1),
        lambda d: F.get("_prior", d) + share * F.aggregate("_slots", F.lit(0.0), lambda a, s: a + F.get(F.col("_weights"), d * BUCKETS + s)),
    )
    seen = seen.withColumn("_weights", weights).withColumn("_score", score).withColumn("tokens", F.size("_slots").cast("long")).drop("_slots", "_prior", "_weights")
    grown = F.transform("_score", lambda s: F.exp(s - F.array_max("_score")))
    seen = seen.withColumn("_grown", grown).drop("_score")
    whole = F.aggregate("_grown", F.lit(0.0), lambda a, x: a + x)
    return seen.withColumn("posterior", F.transform("_grown", lambda x: x / whole)).drop("_grown")


def _rate(history: list[list[float]]) -> Column:
    """The rate after the steps so far, from the residuals that each of them used."""
    rate = F.lit(1.0)
    if not history:
        return rate
    steps = F.array(*[F.array(*[F.lit(x) for x in h]) for h in history])
    size = len(history[0])

    def step(r: Column, h: Column) -> Column:
        slope = sum((F.get("posterior", F.lit(d)) * F.get(h, F.lit(d)) for d in range(size)), F.lit(0.0))
        return F.greatest(F.lit(0.0), r - (slope + PULL * (r - 1)) / (1 + PULL))

    return F.when(F.col("tokens") > 0, F.aggregate(steps, rate, step)).otherwise(rate)


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float] | None, budget: float | None) -> list[list[float]]:
    """Residual history of the fit. members: tokens and posterior. budget: wanted tokens as a multiple of what is there; None: the least at which no domain must shrink."""
    sums = lambda r: members.agg(*[F.sum(r * F.col("tokens") * F.get("posterior", F.lit(d))).alias(f"s{d}") for d in range(len(names))]).first()
    mass = [x or 0.0 for x in sums(F.lit(1.0))]
    total = sum(mass)
    if not total:
        return []
    share = [m / total for m in mass]
    if targets is not None and (unknown := sorted(set(targets) - set(names))):
        raise ValueError(f"no domain of that name: {', '.join(unknown)}; there are {', '.join(names)}")
    want = [s**TEMPER for s in share] if targets is None else [max(0.0, float(targets.get(n, 0.0))) for n in names]
    want = [w if s > 1e-12 else 0.0 for w, s in zip(want, share, strict=True)]
    if not sum(want):
        raise ValueError("no domain with a target has any text")
    want = [w / sum(want) for w in want]
    scale = budget if budget is not None else max(s / w for s, w in zip(share, want, strict=True) if w)
    goal, history, now = [w * scale for w in want], [], share
    for _ in range(STEPS):
        gap = [n - g for n, g in zip(now, goal, strict=True)]
        if max(map(abs, gap)) < CLOSE * scale:
            break
        history.append([x / s if s > 1e-12 else 0.0 for x, s in zip(gap, share, strict=True)])
        before, now = now, [(x or 0.0) / total for x in sums(_rate(history))]
        if max(abs(a - b) for a, b in zip(before, now, strict=True)) < STILL * scale:
            break
    else:
        warnings.warn(f"rates did not settle in {STEPS} steps; farthest domain off by {max(abs(n - g) for n, g in zip(now, goal, strict=True)):.2g} of all tokens", stacklevel=2)
    return history


def copies(rate: Column, seed: int = 11) -> Column:
    """A whole number with the rate as its mean, by a hash of the id: the same on every run."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + (part < rate - F.floor(rate)).cast("long")).cast("long")


def mixture(docs: DataFrame, labelled: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, budget: float | None = 1.0) -> DataFrame:
    """doc_id, tokens, names and posterior of the domains, rate and copies of every row of docs."""
    model = classifier(docs, labelled, domain)
    members = keep(memberships(docs.select("doc_id", "text"), model).drop("text"), "memberships")
    names = model.first()["names"]
    history = fit_rates(members, names, targets, budget)
    out = members.withColumn("rate", _rate(history))
    top = F.get(F.array(*[F.lit(n) for n in names]), F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    return out.select("doc_id", F.col("tokens").alias("n_tokens"), F.array(*[F.lit(n) for n in names]).alias("domains"), "posterior", top.alias("domain"), "rate", copies(F.col("rate")).alias("copies"))


def remix(docs: DataFrame, labelled: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None) -> DataFrame:
    """docs, each row as often as its rate says and at least once: domains short of their target are repeated."""
    model = classifier(docs, labelled, domain)
    members = memberships(packed(docs, "doc_id", "text"), model)
    slim = keep(members.select("tokens", "posterior"), "memberships")
    history = fit_rates(slim, model.first()["names"], targets, None)
    times = F.greatest(F.lit(1), copies(_rate(history))).cast("int")
    return members.withColumn("_times", times).withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
