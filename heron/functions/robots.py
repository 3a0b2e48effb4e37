"""Robots decisions as crawlers make them: groups of agents, the first rule that is a prefix, both kinds of rules.

A file is cut into groups by gaps and islands: user-agent lines in a row begin one group, an empty
line ends it, and rules outside of a group count nowhere. The first group that names the agent holds,
before any group of all agents; of the latter the first. In a group the first rule in order whose
path begins the address decides, allow and disallow alike; where none does, the address is allowed.

Rules are found by equality: of each address only the beginnings as long as some rule of its domain
are looked up. Rules up to RULE_BYTES are broadcast; more are shuffled, where adaptive execution
splits the addresses of a hot domain.

Cases: a domain without a file, or with null content, allows all; of several files of a domain the
smallest content counts. Null addresses and null domains are allowed. Repeated rows are decided each.
Files are read whole, and so are long addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of rules that are broadcast at most.
RULE_BYTES = 16 << 20
#: What ends a line, and the blanks around words.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: Directives that belong to a group; the first two are rules.
GROUPED = ["allow", "disallow", "crawl-delay", "request-rate"]


def unquoted(c: Column) -> Column:
    """Percent escapes resolved; what is no escape stays."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"))


def quoted(c: Column) -> Column:
    """All but letters, digits and _.-~/ escaped."""
    out = F.url_encode(c)
    for a, b in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.regexp_replace(out, a, b)
    return out


def _replaced(c: Column, *steps: tuple[str, str]) -> Column:
    """One replacement after the other, so that no expression is copied."""
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


#: Leading blanks and line ends, an empty fragment, query and parameters are dropped.
TIDY = [(r"\A[\x00-\x20]+", ""), (r"[\t\r\n]", ""), (r"\A([^#]*)#\z", "$1"), (r"\A([^?#]*)\?(?=#|\z)", "$1"), (r"\A((?:[^?#]*/)?[^/;?#]*);(?=[?#]|\z)", "$1")]


def rule_path(value: Column) -> Column:
    """The beginning that the value of a rule stands for."""
    return quoted(_replaced(unquoted(value), *TIDY, (r"\A//(?=/|\z)", "")))


def address_path(url: Column) -> Column:
    """What rules are held against: path, query and fragment of an address or of a path."""
    return quoted(_replaced(unquoted(url), (r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), *TIDY, (r"\A//", "////"), (r"\A\z", "/")))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def rules(files: DataFrame, agent: str) -> DataFrame:
    """domain, pos, allow, path: the rules that hold for the agent, of files (domain, content)."""
    token = agent.split("/")[0].lower()
    one = files.filter("domain is not null and content is not null").groupBy("domain").agg(F.min("content").alias("content"))
    lines = one.select("domain", F.posexplode(F.split("content", LINE_END)).alias("pos", "line"))
    bare = _strip(F.regexp_replace("line", "(?s)#.*$", ""))
    cut = lines.select("domain", "pos", "line", bare.alias("bare")).select("domain", "pos", "line", F.lower(_strip(F.substring_index("bare", ":", 1))).alias("said"), F.when(F.contains("bare", F.lit(":")), _strip(F.expr("substring(bare, instr(bare, ':') + 1)"))).alias("value"))
    kind = F.when(F.col("line") == "", "gap").when(F.col("value").isNotNull() & (F.col("said") == "user-agent"), "agent").when(F.col("value").isNotNull() & F.col("said").isin(GROUPED), "rule")
    marked = cut.withColumn("kind", kind).filter("kind is not null")
    order = Window.partitionBy("domain").orderBy("pos")
    begins = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(order), F.lit("gap")) != "agent")
    inside = F.last(F.when(F.col("kind") != "rule", F.col("kind")), ignorenulls=True).over(order) == "agent"
    held = marked.withColumn("inside", inside).withColumn("part", F.sum(begins.cast("int")).over(order)).filter("inside")
    group = Window.partitionBy("domain", "part")
    name = F.when(F.col("kind") == "agent", unquoted(F.col("value")))
    star, ours = F.max(name == "*").over(group), F.max(F.lit(token).contains(F.lower(name))).over(group)
    told = held.withColumns({"star": star, "ours": ours, "ruled": F.max(F.col("kind") == "rule").over(group)}).filter("ruled")
    domain = Window.partitionBy("domain")
    own, general = (F.min(F.when(c, F.col("part"))).over(domain) for c in (F.col("ours") & ~F.col("star"), F.col("star")))
    chosen = told.withColumn("chosen", F.coalesce(own, general)).filter("part = chosen and said in ('allow', 'disallow') and kind = 'rule'")
    return chosen.select("domain", "pos", ((F.col("said") == "allow") | (F.col("value") == "")).alias("allow"), rule_path(F.col("value")).alias("path"))


def decisions(paths: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """paths (domain, path, and what else) with `allowed`: whether the agent may fetch the path, or the address."""
    first = rules(files, agent).groupBy("domain", F.col("path").alias("_begin")).agg(F.min(F.struct("pos", "allow")).alias("_rule"))
    size = first.agg(F.sum(F.octet_length("_begin") + F.octet_length("domain") + 16)).first()[0] or 0
    small = F.broadcast if size <= RULE_BYTES else (lambda df: df)
    lengths = first.groupBy("domain").agg(F.collect_set(F.length("_begin")).alias("_lengths"))  # as many as a file has rules, at most
    asked = paths.select("domain", F.col("path").alias("_asked")).distinct().join(small(lengths), "domain")
    path = asked.withColumn("_path", address_path(F.col("_asked")))
    cut = path.select("domain", "_asked", "_path", F.explode("_lengths").alias("_n")).filter("_n <= length(_path)").select("domain", "_asked", F.expr("left(_path, _n)").alias("_begin"))
    found = cut.join(small(first), ["domain", "_begin"]).groupBy("domain", "_asked").agg(F.min("_rule")["allow"].alias("_allow"))
    both = found.select(F.col("domain").alias("_domain"), "_asked", "_allow")
    return paths.join(both, (paths["domain"] == both["_domain"]) & (paths["path"] == both["_asked"]), "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_domain", "_asked", "_allow")
