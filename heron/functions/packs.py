"""Rule packs as tables: a pack for each site, its rules joined as rows, few of them tried.

A rule is a pattern with a label, of a kind ("page_type", "priority", "product"), in order; the first
that is found in an address gives the label. Most patterns can't match without some literal text, so
each rule is indexed by a gram of its longest literal. An address is cut into its grams, an equality
join on pack and gram finds the rules that may match, and only these patterns are run. Rules without
a literal of GRAM characters are tried on every address of the pack.

Packs come from profile files, one JSON object a line: {"name": ..., "rules": {kind: {label: [pattern,
...]}}}; labels and patterns are tried as they stand. Sites without a pack of their own take `default`.

Cases: null addresses and sites match nothing and keep null labels; a broken pattern is taken as text;
profiles without a name are left out, and of equal names the smallest content counts. Patterns are
matched in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.functions.spans import bound

GRAM = 3
#: Bytes of rules that are broadcast at most.
RULE_BYTES = 16 << 20
#: Escaped signs stand as private characters while the signs that mean something are cut out.
SIGNS = "./?+*-()[]{}|$^\\"
PRIVATE = "".join(chr(0xE000 + k) for k in range(len(SIGNS)))
PROFILE = "name string, rules map<string, map<string, array<string>>>"


def literal(pattern: Column) -> Column:
    """The longest text, lower-case, that whatever matches the pattern holds; empty where none is known."""
    out = pattern
    for sign, held in zip(SIGNS, PRIVATE, strict=True):
        out = F.replace(out, F.lit(f"\\{sign}"), F.lit(held))
    out = F.when(F.contains(out, F.lit("|")) | F.contains(out, F.lit("(")), F.lit("")).otherwise(out)
    for meaning in (r"\\.", r"\[[^\]]*\]", r".[?*]\??", r".\{[^}]*\}\??"):
        out = F.regexp_replace(out, f"(?s){meaning}", "\n")
    parts = F.split(F.regexp_replace(out, r"[.^$+()\[\]{}]", "\n"), "\n")
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    # letters whose lower case is longer or shorter aren't held against addresses
    return F.when(longest.rlike(r"^[\x00-\x7F\x{E000}-\x{E0FF}]*$"), F.lower(F.translate(longest, PRIVATE, SIGNS))).otherwise("")


def safe(pattern: Column) -> Column:
    """The pattern, or its text quoted where brackets don't close."""
    bare = F.regexp_replace(pattern, r"\\.|\[\^?\]?[^\]]*\]", "")
    count = lambda sign: F.length(bare) - F.length(F.replace(bare, F.lit(sign), F.lit("")))
    whole = (count("(") == count(")")) & (count("[") == 0) & ~bare.rlike(r"^[?*+]|[(|][?*+](?![:!=<])|\\$|[?*+][*]|\([^)]*$")
    return F.when(whole, pattern).otherwise(F.concat(F.lit("\\Q"), pattern, F.lit("\\E")))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """pack, kind, ord, label, pattern of the profile files in a folder."""
    name = F.get_json_object("value", "$.name")
    one = spark.read.text(folder).select(name.alias("pack"), "value").filter("pack is not null").groupBy("pack").agg(F.min("value").alias("value"))
    kinds = one.select("pack", F.explode(F.map_entries(F.from_json("value", PROFILE)["rules"])).alias("k")).select("pack", F.col("k.key").alias("kind"), F.posexplode(F.map_entries("k.value")).alias("a", "l"))
    rules = kinds.select("pack", "kind", "a", F.col("l.key").alias("label"), F.posexplode("l.value").alias("b", "pattern"))
    return rules.filter("pattern is not null").select("pack", "kind", (F.col("a") * F.lit(100000).cast("long") + F.col("b")).alias("ord"), "label", "pattern")


def indexed(rules: DataFrame) -> DataFrame:
    """rules with the text that a match holds (need), the gram they are found by, and the pattern that is run."""
    sound = rules.withColumn("run", safe(F.col("pattern")))
    need = F.when(F.col("run") == F.col("pattern"), literal(F.col("pattern"))).otherwise(F.when(F.col("pattern").rlike(r"^[\x00-\x7F]*$"), F.lower("pattern")).otherwise(""))
    out = sound.withColumn("need", need)
    # the middle of a literal tells more than its beginning, which is often a slash and a common word
    gram = F.substring(F.col("need"), F.floor((F.length("need") - GRAM) / 2).cast("int") + 1, F.lit(GRAM))
    return out.withColumn("gram", F.when(F.length("need") < GRAM, "").otherwise(gram)).withColumn("run", F.concat(F.lit("(?iu)"), F.col("run")))


def folded(path: Column) -> Column:
    """Lower-case, with the one further letter that matches an s in any case."""
    return F.lower(F.translate(path, "\u017f", "s"))


def grams(path: Column) -> Column:
    """The distinct grams of an address, lower-case, and the empty one."""

    def cut(low: Column) -> Column:
        starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_append(F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM)))), "")

    return bound(folded(path), cut)


def candidates(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """pack, path with each indexed rule whose text the path holds: the rules whose patterns are run."""
    cut = asked.select("pack", "path", F.explode(grams(F.col("path"))).alias("gram"))
    return cut.join(rules, ["pack", "gram"]).filter(F.contains(folded(F.col("path")), F.col("need")))


def labels(addresses: DataFrame, rules: DataFrame, kinds: list[str], default: str = "default") -> DataFrame:
    """addresses (site, path, and what else) with a column for each kind: the label of the first rule of the site's pack found in the path."""
    held = indexed(rules.filter(F.col("kind").isin(kinds)))
    size = held.agg(F.sum(F.octet_length("pack") + F.octet_length("label") + 2 * F.octet_length("pattern") + 64)).first()[0] or 0
    small = F.broadcast if size <= RULE_BYTES else (lambda df: df)
    packs = held.select(F.col("pack").alias("_own")).distinct()
    asked = addresses.filter("path is not null and site is not null").select("site", "path").distinct()
    asked = asked.join(small(packs), asked["site"] == F.col("_own"), "left").select("site", F.coalesce("_own", F.lit(default)).alias("pack"), "path")
    hit = candidates(asked.select("pack", "path").distinct(), small(held)).filter(F.expr("path rlike run"))
    first = hit.groupBy("pack", "path").agg(*(F.min(F.when(F.col("kind") == k, F.struct("ord", "label")))["label"].alias(f"_{k}") for k in kinds))
    found = asked.join(first, ["pack", "path"]).select(F.col("site").alias("_site"), F.col("path").alias("_path"), *(f"_{k}" for k in kinds))
    both = addresses.join(found, (addresses["site"] == found["_site"]) & (addresses["path"] == found["_path"]), "left")
    return both.select(*(addresses[c] for c in addresses.columns), *(F.col(f"_{k}").alias(k) for k in kinds))
