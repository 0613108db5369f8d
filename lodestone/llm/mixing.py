"""Mixing sources to target weights by hierarchical budgeting.

A tree of weights over domain, language and source splits a token budget from
the root down. A child that has fewer tokens than its share, epochs counted,
passes the shortage to its siblings by their weights; only where all siblings
are used up does it reach the parent's siblings. Each leaf then takes whole
epochs, and of one more epoch the prefix, in that epoch's seeded order, whose
tokens fit what is left of its budget.

Prefixes need no sorting of a leaf: the order's hash, of id and text, gives a
bucket, tokens are summed by leaf and bucket, and only the rows of the one
bucket in which a prefix ends are ordered. A source with a third of all rows is
spread like any other, and so are rows of which all ids are null or one. Rows
equal in id and text share a bucket; where a prefix ends among them, one task
orders them, spilling to disk. What comes to the driver is a few numbers a leaf;
leaves are bounded by the given tree, as names that it lacks count as "other" at
each level.

Defined cases: null domains, languages and sources count as "other"; a null or
empty text has no tokens and goes with its leaf's order, once where the whole
leaf has no tokens; rows with a null id are ordered by their texts alone;
repeated rows are taken each; an empty table or a budget of 0 gives no rows;
extra columns pass through, and an input column with the name of an output
column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_name, whole_text, written

OTHER = "other"
BUCKETS = 4096

LANGUAGES = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
#: The production tree: domain -> (weight, language -> (weight, source -> weight)).
TREE = {
    "web": (5.0, {lang: (w, {f"src{i}": 1.0 for i in range(10)}) for lang, w in LANGUAGES.items()}),
    "books": (3.0, {lang: (w, {f"src{i}": 1.0 for i in range(10, 15)}) for lang, w in LANGUAGES.items()}),
    "forums": (2.0, {lang: (w, {f"src{i}": 1.0 for i in range(15, 20)}) for lang, w in LANGUAGES.items()}),
}
OTHER_WEIGHT = 1.0
EPOCHS = 2
#: The production budget, as a share of the tokens there are.
SHARE = 0.8
SEED = 7


def domain_of_source(tree=TREE) -> Column:
    """The domain in whose subtree a source is listed; null if in none."""
    out = F.lit(None).cast("string")
    for domain, (_, languages) in tree.items():
        names = sorted({s for _, sources in languages.values() for s in sources})
        out = F.when(F.col("source").isin(names), domain).otherwise(out)
    return out


def fill(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Splits a budget by weight among children (weight, capacity): what a
    child cannot take goes to the others by their weights."""
    out = [0.0] * len(children)
    order = sorted((i for i, (w, c) in enumerate(children) if w > 0 and c > 0), key=lambda i: (children[i][1] / children[i][0], i))
    left, weights = min(budget, sum(children[i][1] for i in order)), sum(children[i][0] for i in order)
    for i in order:
        weight, capacity = children[i]
        out[i] = min(capacity, left * weight / weights)
        left -= out[i]
        weights -= weight
        if weights <= 1e-12:
            break
    return out


def leaf_budgets(tree, tokens: dict[tuple[str, str, str], int], budget: int, epochs: int, other: float = OTHER_WEIGHT) -> dict[tuple[str, str, str], int]:
    """The tokens that each leaf (domain, language, source) may take."""

    def children(path: tuple[str, ...], node):
        """(name, weight, subtree) below a node that has tokens somewhere."""
        for name in sorted({leaf[len(path)] for leaf in tokens if leaf[: len(path)] == path}):
            below = (node or {}).get(name)
            if below is None:
                yield name, other, None
            else:
                yield (name, *below) if isinstance(below, tuple) else (name, below, None)

    def split(path, node, amount):
        if len(path) == 3:
            return {path: int(amount + 1e-6)}
        found = list(children(path, node))
        capacity = [sum(n for leaf, n in tokens.items() if leaf[: len(path) + 1] == (*path, name)) * epochs for name, _, _ in found]
        out = {}
        for (name, _, below), part in zip(found, fill(amount, [(w, c) for (_, w, _), c in zip(found, capacity)])):
            out |= split((*path, name), below, part)
        return out

    return split((), tree, float(budget))


def _level(column: Column, names) -> Column:
    return F.when(column.isin(sorted(names)), column).otherwise(OTHER)


def _tokens(text: str) -> Column:
    return F.regexp_count(whole_text(text), F.lit(r"[^ \t-\r]+")).cast("long")


def mix(docs: DataFrame, tree=TREE, domain: Column | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The chosen rows of docs (doc_id, text, lang, source, ...), one for each
    epoch in which a row is taken, with domain, n_tokens and epoch (from 0).

    A token is a word. The budget is `share` of all tokens of the table.
    """
    spark = docs.sparkSession
    domain = domain_of_source(tree) if domain is None else domain
    languages = {lang for _, below in tree.values() for lang in below}
    sources = {s for _, below in tree.values() for _, names in below.values() for s in names}
    at = fresh_name(docs, "leaf")
    leaf = F.struct(_level(domain, tree).alias("d"), _level(F.col("lang"), languages).alias("l"), _level(F.col("source"), sources).alias("s"))
    digest = F.xxhash64(whole_text(text)).alias("h")
    slim = written(docs.select(F.col(id).alias("id"), digest, leaf.alias("leaf"), _tokens(text).alias("n")), "mix")

    stats = {tuple(r["leaf"]): r["n"] for r in slim.groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    tokens = {leaf: n for leaf, n in stats.items() if n}
    budgets = leaf_budgets(tree, tokens, int(sum(tokens.values()) * share), epochs)
    plan = [(leaf, min(budgets[leaf] // n, epochs), budgets[leaf] % n if budgets[leaf] // n < epochs else 0) for leaf, n in tokens.items()]
    plan += [(leaf, 1, 0) for leaf in stats if leaf not in tokens and any(budgets.values())]  # costs nothing
    plan = spark.createDataFrame(plan, "leaf struct<d:string,l:string,s:string>, whole int, rest long")  # a row for each leaf of the tree at most

    # hexadecimal hash: the seeded order of the epoch after the whole ones
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("whole", "id", "h")]))
    bucket = F.conv(F.substring("o", 1, 3), 16, 10).cast("int")
    sums = slim.join(F.broadcast(plan), "leaf").withColumn("o", order).groupBy("leaf", "rest", bucket.alias("b")).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("leaf").orderBy("b"))
    # the first bucket in which the tokens exceed the rest, and the tokens before it
    ends = sums.withColumn("upto", upto).filter("upto > rest").groupBy("leaf").agg(F.min_by(F.struct("b", (F.col("upto") - F.col("n")).alias("before")), "b").alias("end"))
    ends = spark.createDataFrame(ends.select("leaf", "end.b", "end.before").collect(), "leaf struct<d:string,l:string,s:string>, end int, before long")
    plan = plan.join(ends, "leaf", "left").select(F.struct("leaf.*", "whole", "rest", "end", "before").alias("p"))

    own = [c for c in docs.columns if c not in ("domain", "n_tokens", "epoch")]
    df = docs.select(F.struct(*own).alias("row"), F.col(id).alias("id"), digest, leaf.alias(at), _tokens(text).alias("n"))
    df = df.join(F.broadcast(plan), (F.col(f"{at}.d") == F.col("p.d")) & (F.col(f"{at}.l") == F.col("p.l")) & (F.col(f"{at}.s") == F.col("p.s")))
    df = df.select("*", "p.whole", "p.rest", "p.end", "p.before").withColumn("o", order).withColumn("b", bucket)
    inside = F.col("b") < F.coalesce("end", F.lit(BUCKETS))
    sure = df.filter((F.col("b") != F.col("end")) | F.col("end").isNull()).withColumn("taken", F.col("whole") + (inside & (F.col("rest") > 0)).cast("int"))
    run = F.sum("n").over(Window.partitionBy(at).orderBy("o", "id", "h").rowsBetween(Window.unboundedPreceding, 0))
    edge = df.filter(F.col("b") == F.col("end")).withColumn("taken", F.col("whole") + ((F.col("before") + run <= F.col("rest")) & (F.col("rest") > 0)).cast("int"))
    df = sure.unionByName(edge).filter("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("taken") - 1)))
    return df.select("row.*", F.col(f"{at}.d").alias("domain"), F.col("n").alias("n_tokens"), "epoch")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs).drop("text")
