"""URL filter in the DataFrame API: host and path rules, and a character language-model ratio for the rest.

URLs that a rule decides are the training text: one model of accepted and one of rejected URLs. A model is a smoothed
variable-order Markov chain over a fixed alphabet: p(x | ab) = (n(abx) + B p(x | b)) / (n(ab) + B), and so on down to
single characters; the longest context seen in either class is used. The score is the mean log-likelihood difference a
character. Its threshold is calibrated on labelled URLs that the models have not learnt from.

The alphabet and the order bound the model: at most ``len(ALPHABET) ** ORDER`` rows, so it is broadcast.
"""

from pyspark.sql import Column, DataFrame, functions as F

from adlake.llm.tables import needs, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Begin, end, any other character, and the characters told apart.
ALPHABET = "^$*" + _LOWER + "0123456789" + "./_?=&#%:@~+-"
ORDER = 3
_PRIOR = 4.0
# Rules: verdict, host, path.
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """From behind the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (host and path) for the host or a domain above it whose path begins the path, as a struct of
    rule and verdict, or null. Of equally long rules the first of the list counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _signs(url: Column) -> Column:
    """The URL in the model's alphabet, framed by begin and end."""
    plain = F.regexp_replace(F.translate(url, _UPPER, _LOWER), "[^a-z0-9./_?=&#%:@~+-]", "*")
    return F.concat(F.lit("^" * (ORDER - 1)), plain, F.lit("$"))


def _positions(urls: DataFrame, *keep: str) -> DataFrame:
    """A row per predicted character with its context of ORDER - 1 characters."""
    signs = F.split(_signs(F.col("url")), "(?!^)(?!$)", -1)
    grams = F.transform(F.sequence(F.lit(1), F.size("signs") - (ORDER - 1)),
                        lambda i: F.array_join(F.slice("signs", i, ORDER), ""))
    return urls.withColumn("signs", signs).select(*keep, F.explode(grams).alias("gram"))


def train(labelled: DataFrame) -> DataFrame:
    """(context, sign, ratio) from (url, accepted boolean): log p of accepted less log p of rejected, natural.

    Contexts of every length from 0 to ORDER - 1 that either class has, each with the whole alphabet.
    """
    grams = (_positions(labelled, "accepted").groupBy("gram")
             .agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no")))
    model = None
    for order in range(1, ORDER + 1):
        own = grams.groupBy(F.substring("gram", ORDER - order + 1, order).alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        context = F.substring("gram", 1, order - 1)
        total = own.groupBy(context.alias("context")).agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
        full = total.select("*", F.explode(F.array(*[F.lit(x) for x in ALPHABET])).alias("sign")).withColumn("gram", F.concat("context", "sign"))
        full = full.join(F.broadcast(own), "gram", "left").fillna(0, ["yes", "no"])
        if model is None:
            lower = [F.lit(1.0 / len(ALPHABET))] * 2
        else:
            shorter = model.where(F.length("context") == order - 2).select(
                F.col("context").alias("_context"), F.col("sign").alias("_sign"), F.col("p_yes").alias("q_yes"), F.col("p_no").alias("q_no"))
            full = full.join(F.broadcast(shorter), (F.substring("context", 2, order) == F.col("_context")) & (F.col("sign") == F.col("_sign")))
            lower = [F.col("q_yes"), F.col("q_no")]
        p_yes = (F.col("yes") + _PRIOR * lower[0]) / (F.col("all_yes") + _PRIOR)
        p_no = (F.col("no") + _PRIOR * lower[1]) / (F.col("all_no") + _PRIOR)
        level = full.select("context", "sign", p_yes.alias("p_yes"), p_no.alias("p_no"))
        model = level if model is None else model.union(level)
        model = written(model)
    return written(model.select("context", "sign", F.log(F.col("p_yes") / F.col("p_no")).alias("ratio")))


def scores(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(url, score) of distinct urls: the mean ratio a character; 0 where the model is empty."""
    each = _positions(urls, "url")
    ratio = F.lit(0.0)
    for order in range(1, ORDER + 1):
        level = model.where(F.length("context") == order - 1).select(
            F.concat("context", "sign").alias("_gram"), F.col("ratio").alias(f"r{order}"))
        each = each.join(F.broadcast(level), F.substring("gram", ORDER - order + 1, order) == F.col("_gram"), "left").drop("_gram")
        ratio = F.coalesce(F.col(f"r{order}"), ratio)
    return each.groupBy("url").agg(F.avg(ratio).alias("score"))


def threshold(scored: DataFrame) -> float:
    """From (score, accepted) of labelled URLs: the point as many deviations from either class's mean, else 0."""
    found = {r["accepted"]: (r["m"], r["s"] or 0.0) for r in scored.groupBy("accepted").agg(
        F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}
    if True not in found or False not in found:
        return 0.0
    (yes, s_yes), (no, s_no) = found[True], found[False]
    spread = s_yes + s_no
    return (yes * s_no + no * s_yes) / spread if spread else (yes + no) / 2


def judge(pages: DataFrame, rules: list[Rule], id_column: str = "page_id") -> DataFrame:
    """Every page's id, host, path, rule (null if none fits), verdict (allow or block) and score.

    The verdict is the rule's, else allow where the score reaches the threshold. A null URL counts as an empty one, with
    empty host and path. Models learn each distinct URL once, from four fifths of those that a rule decides; the rest
    calibrate. If rules decide no URL of one kind, the threshold is 0, and without any the verdict is allow. Repeated
    rows are judged each; an empty table gives no rows. Other columns are not read.
    """
    rows = needs(pages, id_column, "url").select(F.col(id_column), F.coalesce("url", F.lit("")).alias("url"))
    urls = rows.select("url").distinct()
    ruled = written(urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
                    .withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)))
    # URLs are few bytes and become a row per character: a number of partitions of its own, which AQE does not join by bytes.
    # The scores then are summed where their URL already is.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ruled.repartition(parts, "url")
    labelled = spread.where("fit is not null").select("url", (F.col("fit.verdict") == "allow").alias("accepted"),
                                                     (F.crc32("url") % 5 == 0).alias("calibrates"))
    scored = written(scores(spread.select("url"), train(labelled.where(~F.col("calibrates")))))
    least = threshold(labelled.where("calibrates").join(scored, "url"))
    method = F.when(F.col("score") >= least, "allow").otherwise("block")
    judged = ruled.join(scored, "url").select("url", "host", "path", F.col("fit.rule").alias("rule"),
                                              F.coalesce("fit.verdict", method).alias("verdict"), "score")
    return rows.join(judged, "url").select(id_column, "host", "path", "rule", "verdict", "score")
