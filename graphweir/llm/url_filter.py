"""URL verdicts by rules and gradient-boosted trees (DataFrame functions only).

Rules decide the urls that they fit and so label them; trees trained on those labels decide
the rest, from lexical features of the url.  A boosting round is one aggregation per tree
level: gradients and curvatures are summed by node, feature and bin over a bounded, binned
training table, and the best cuts are chosen from those sums (at most nodes x features x
bins of them).  The finished trees are one SQL expression over the features.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweir.plans.durable import durable

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: About so many distinct labelled urls the trees are fitted on, chosen by a hash of the url; suffix rates are over all.
TRAIN_ROWS = 20_000
ROUNDS, DEPTH, BINS, RATE, RIDGE = 10, 3, 16, 0.4, 1.0
#: A url that is learned from sees the rates of the other folds only, so that its own label does not leak.
FOLDS = 4
#: Weight of the prior in a suffix's share of blocked urls.
SMOOTHING = 10.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
FEATURES = "length depth path_length digits digit_ratio entropy params fragment secure labels host_length host_digits hyphens longest_digits letters_path suffix1 suffix2 suffix3".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, PARTS, 1), UPPER, LOWER), F.regexp_extract(u, PARTS, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null for none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one tested wins
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need only the url; all are doubles."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    digits = F.length(u) - F.length(F.regexp_replace(u, "[0-9]", ""))
    chars = F.array_sort(F.split(u, ""))
    # entropy from run lengths of the sorted characters: log n - sum c log c / n
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("s"))
    gain = lambda a: F.when(a["k"] > 0, a["k"] * F.log(a["k"])).otherwise(0.0)
    entropy = F.log(n) - F.aggregate(
        chars,
        start,
        lambda a, c: F.struct(c.alias("c"), F.when(a["c"] == c, a["k"] + 1.0).otherwise(1.0).alias("k"), F.when(a["c"] == c, a["s"]).otherwise(a["s"] + gain(a)).alias("s")),
        lambda a: a["s"] + gain(a),
    ) / n
    made = {
        "length": F.length(u),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "path_length": F.length(path),
        "digits": digits,
        "digit_ratio": digits / n,
        "entropy": entropy,
        "params": F.when(F.contains(u, F.lit("?")), F.regexp_count(u, F.lit("[?&][^?&#=]+=?"))).otherwise(0),
        "fragment": F.contains(u, F.lit("#")).cast("int"),
        "secure": F.startswith(u, F.lit("https:")).cast("int"),
        "labels": F.regexp_count(host, F.lit("[^.]+")),
        "host_length": F.length(host),
        "host_digits": F.length(host) - F.length(F.regexp_replace(host, "[0-9]", "")),
        "hyphens": F.length(u) - F.length(F.replace(u, F.lit("-"), F.lit(""))),
        "longest_digits": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(u, F.lit("[0-9]+"), F.lit(0)), F.length)), F.lit(0)),
        "letters_path": F.regexp_count(path, F.lit("[A-Za-z]")),
    }
    return {k: v.cast("double") for k, v in made.items()}


def suffixes(host: Column, path: Column) -> list[Column]:
    """Last label, last two labels, and last label with the first path segment."""
    return [F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), F.concat(F.substring_index(host, ".", -1), F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2)))]


def fold_of(url: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS))


def suffix_rates(train: DataFrame, k: int) -> DataFrame:
    """By suffix: labelled urls and blocked ones among them, in all and by fold."""
    folds = [F.struct(F.count_if(F.col("fold") == f).alias("n"), F.sum(F.when(F.col("fold") == f, F.col("y")).otherwise(0)).alias("y")) for f in range(FOLDS)]
    return train.groupBy(F.col(f"key{k}").alias(f"k{k}_")).agg(F.count("*").alias("n_"), F.sum("y").alias("y_"), F.array(*folds).alias("folds_"))


def with_rates(rows: DataFrame, rates: list[DataFrame], prior: float, out_of_fold: bool) -> DataFrame:
    """Adds the share of blocked urls of each suffix; of the other folds only, for urls that are learned from."""
    for k, r in enumerate(rates, 1):
        rows = rows.join(r, F.col(f"key{k}") == F.col(f"k{k}_"), "left")
        own = (lambda x: F.get("folds_", F.col("fold"))[x]) if out_of_fold else (lambda x: F.lit(0))
        blocked, seen = (F.coalesce(F.col(f"{x}_") - own(x), F.lit(0)) for x in ("y", "n"))
        rate = (blocked + SMOOTHING * prior) / (seen + SMOOTHING)
        rows = rows.withColumn(f"suffix{k}", rate.cast("double")).drop(f"k{k}_", "n_", "y_", "folds_")
    return rows


def tree_sql(tree: dict, name) -> str:
    """A tree as nested CASE; ``name(feature, cut)`` is the test that goes left."""
    if "feature" not in tree:
        return f"{tree['value']:.12g}D"
    test = name(tree["feature"], tree["cut"])
    return f"CASE WHEN {test} THEN {tree_sql(tree['left'], name)} ELSE {tree_sql(tree['right'], name)} END"


def grow(binned: DataFrame, margin: str, cuts: list[list[float]]) -> dict:
    """One tree for the logistic loss at ``margin``, grown level by level; a job per level.

    Sums are of decimals, so that they do not depend on the order of rows.
    """
    tree: dict = {"id": 1}
    open_ = {1: tree}
    long_rows = ", ".join(f"{i}, b{i}" for i in range(len(cuts)))
    for _ in range(DEPTH):
        if not open_:
            break
        node = tree_node(tree, lambda f, c: f"b{f} <= {c}")
        grads = binned.selectExpr("*", f"({node}) AS node", f"1D / (1D + exp(-({margin}))) AS p").filter(f"node IN ({', '.join(map(str, open_))})")
        sums = grads.selectExpr("node", "cast(y - p AS decimal(18, 12)) AS g", "cast(p * (1 - p) AS decimal(18, 12)) AS h", f"stack({len(cuts)}, {long_rows}) AS (f, b)").groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        table: dict = {}
        for r in sums.collect():  # at most nodes x features x bins
            table.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (float(r["g"]), float(r["h"]))
        following = {}
        for i, leaf in open_.items():
            total = [math.fsum(v[k] for v in table[i][0].values()) for k in (0, 1)] if i in table else [0.0, 0.0]
            best, left = 1e-6, None
            for f in sorted(table.get(i, {})):
                g = h = 0.0
                for b in range(len(cuts[f])):
                    dg, dh = table[i][f].get(b, (0.0, 0.0))
                    g, h = g + dg, h + dh
                    if min(h, total[1] - h) < 1e-3:
                        continue
                    gain = g * g / (h + RIDGE) + (total[0] - g) ** 2 / (total[1] - h + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
                    if gain > best + 1e-9:
                        best, left = gain, (f, b, g, h)
            if left is None:
                leaf["value"] = RATE * total[0] / (total[1] + RIDGE)
                continue
            f, b, g, h = left
            leaf |= {"feature": f, "cut": b, "left": {"id": 2 * i, "value": RATE * g / (h + RIDGE)}, "right": {"id": 2 * i + 1, "value": RATE * (total[0] - g) / (total[1] - h + RIDGE)}}
            following |= {2 * i: leaf["left"], 2 * i + 1: leaf["right"]}
        open_ = following
    return tree


def tree_node(tree: dict, name) -> str:
    if "feature" not in tree:
        return str(tree["id"])
    return f"CASE WHEN {name(tree['feature'], tree['cut'])} THEN {tree_node(tree['left'], name)} ELSE {tree_node(tree['right'], name)} END"


def boosted(train: DataFrame, features: list[str], prior: float) -> str:
    """The margin (log odds of block) as a SQL expression over the features."""
    base = math.log(prior / (1 - prior))
    probs = [k / BINS for k in range(1, BINS)]
    row = train.agg(*[F.percentile(f, probs).alias(f) for f in features]).first()  # exact, so that the order of rows does not matter
    cuts = [sorted(set(row[f])) for f in features]

    def bin_of(i: int) -> Column:  # cuts below the value
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[i]]), lambda c: c < F.col(features[i]))).alias(f"b{i}")

    bins = [bin_of(i) for i in range(len(features))]
    binned = durable(train.select("y", *bins), "url-bins")
    margin, trees = f"{base:.12g}D", []
    for _ in range(ROUNDS):
        tree = grow(binned, margin, cuts)
        trees.append(tree)
        margin += f" + {tree_sql(tree, lambda f, c: f'b{f} <= {c}')}"
    return " + ".join([f"{base:.12g}D", *(tree_sql(t, lambda f, c: f"{features[f]} <= {cuts[f][c]!r}D") for t in trees)])


def verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, train_rows: int = TRAIN_ROWS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score.

    ``score`` is the trees' probability of block.  A null url, or one without ``://``, has
    empty host and path and is judged by the trees, as is every url that no rule fits.  If
    the rules label nothing, or all alike, such urls get the verdict that the labelled ones
    have, ``allow`` if there are none.  Only the characters A to Z of a host are lower-cased.
    Rows that repeat a url are judged alike; whole urls count, however long; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    host, path = host_and_path(F.col("u"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    keys = suffixes(F.col("host"), F.col("path"))
    labelled = rows.filter("ruled is not null").select("u", "host", "path", (F.col("ruled") == "block").cast("int").alias("y"))
    labelled = durable(labelled.dropDuplicates(["u"]), "url-labelled")
    count = labelled.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    n, blocked = count["n"], count["y"] or 0
    spread = 1 << 20
    share = min(spread, math.ceil(spread * train_rows / max(n, 1)))
    one_sided = blocked in (0, n)
    prior = (blocked + 0.5) / (n + 1)
    rows = rows.withColumns({f"key{k}": c for k, c in enumerate(keys, 1)}).withColumns(lexical(F.col("u"), F.col("host"), F.col("path")))
    if one_sided:
        out = rows.withColumn("score", F.lit(float(n > 0 and blocked == n)))
    else:
        labelled = labelled.withColumns({f"key{k}": c for k, c in enumerate(keys, 1)}).withColumn("fold", fold_of("u"))
        some = labelled.filter(F.pmod(F.xxhash64("u"), F.lit(spread)) < share).withColumns(lexical(F.col("u"), F.col("host"), F.col("path")))
        train = durable(some.drop("u", "host", "path"), "url-train")
        rates = [durable(suffix_rates(labelled, k), "url-suffixes") for k in (1, 2, 3)]
        margin = boosted(with_rates(train, rates, prior, True), FEATURES, prior)
        out = with_rates(rows, rates, prior, False).withColumn("score", F.expr(f"1D / (1D + exp(-({margin})))"))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
