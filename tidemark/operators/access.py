"""Ordered access rules: coverage, shadowing, order and decisions.

``rules(rule_no, type, database, user, address, method)``; earlier rules win. Networks are texts ``lo`` to
``hi``: ``4`` or ``6`` and the address in hexadecimal digits, so that those of one family compare as numbers
and those of two never meet. What an address covers may be unknown (host names), and then is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Addresses of the machine itself, from which trust is no fault.
LOOPBACK = ["127.0.0.1/32", "::1/128"]
V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?:/(\d{1,2}))?$"


GROUPS = r"(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)?"


def _six(address: Column) -> Column:
    """Struct of ``lo``, ``hi`` and ``prefix`` of an IPv6 network; null for anything else."""
    host = F.lower(F.substring_index(address, "/", 1))
    halves = F.split(host, "::")
    groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
    digits = lambda half: F.array_join(F.transform(groups(half), lambda g: F.lpad(g, 4, "0")), "")
    short = F.size(halves) == 2
    behind = F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
    missing = 8 - F.size(groups(halves[0])) - F.size(groups(behind))
    number = F.concat(digits(halves[0]), F.repeat(F.lit("0"), 4 * missing), digits(behind))
    after = F.regexp_extract(address, r"/(\d{1,3})$", 1)
    prefix = F.when(after == "", 128).otherwise(F.nullif(after, F.lit("")).cast("int"))
    whole = F.floor(prefix / 4).cast("int")  # digits that the prefix fixes; the next one it fixes in part
    span = F.pow(F.lit(2.0), 4 - prefix % 4).cast("int")
    digit = F.conv(F.substring(number, whole + 1, F.lit(1)), 16, 10).cast("int")
    end = lambda last, fill: F.concat(F.lit("6"), F.substring(number, F.lit(1), whole), F.when(whole < 32, F.lower(F.hex(last))).otherwise(""), F.repeat(F.lit(fill), 31 - whole))
    low = digit - digit % span
    valid = address.rlike(rf"^{GROUPS}(?:::{GROUPS})?(?:/\d{{1,3}})?$") & address.contains(":") & F.when(short, missing >= 1).otherwise(missing == 0) & (prefix <= 128)
    return F.when(valid, F.struct(end(low, "0").alias("lo"), end(low + span - 1, "f").alias("hi"), prefix.alias("prefix")))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once and not in each use."""
    return F.transform(F.array(value), body)[0]


def _four(address: Column) -> Column:
    """Struct of ``lo``, ``hi`` and ``prefix`` of an address that looks like ``V4``; null if a number is too large."""
    digits = lambda n: F.concat(F.lit("4"), F.lpad(F.lower(F.hex(n)), 8, "0"))

    def bounds(n: Column) -> Column:
        prefix = F.coalesce(F.get(n, F.lit(4)), F.lit(32)).cast("int")
        size = F.pow(F.lit(2.0), 32 - prefix).cast("long")
        found = _once(F.struct((n[0] * 16777216 + n[1] * 65536 + n[2] * 256 + n[3]).alias("number"), size.alias("size")), lambda x: F.struct(digits(x["number"] - x["number"] % x["size"]).alias("lo"), digits(x["number"] - x["number"] % x["size"] + x["size"] - 1).alias("hi"), prefix.alias("prefix")))
        return F.when((F.greatest(n[0], n[1], n[2], n[3]) <= 255) & (prefix <= 32), found)

    return _once(F.transform(F.split(address, "[./]"), lambda x: x.cast("long")), bounds)


def network(address: Column) -> Column:
    """Struct of ``lo``, ``hi`` and ``prefix`` of an IPv4 or IPv6 network, of ``all`` as a whole; null for host names."""
    whole = F.struct(F.lit("4").alias("lo"), F.lit("7").alias("hi"), F.lit(0).alias("prefix"))  # of both families
    return F.when(F.coalesce(address, F.lit("")).isin("", "all"), whole).when(address.rlike(V4), _four(address)).when(address.contains(":"), _six(address))


def tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.regexp_replace(F.trim(t), r'^"|"$', "")), lambda t: t != "")


def prepared(rules: DataFrame) -> DataFrame:
    return rules.withColumns({"net": network(F.col("address")), "dbs": tokens(F.col("database")), "users": tokens(F.col("user"))})


def _list_covers(a: Column, b: Column) -> Column:
    return F.when(F.array_contains(a, "all"), ~F.array_contains(b, "replication")).otherwise(F.size(F.array_except(b, a)) == 0)


def _type_covers(a: Column, b: Column) -> Column:
    return (a == b) | ((a == "host") & b.isin("hostssl", "hostnossl"))


def _address_covers(a: str, b: str) -> Column:
    x, y = F.col(f"{a}.net"), F.col(f"{b}.net")
    same = F.col(f"{a}.address") == F.col(f"{b}.address")
    return F.when(F.col(f"{a}.address") == "all", True).when(x.isNull() | y.isNull(), F.when(same, True)).when(F.col(f"{b}.address") == "all", False).otherwise((x["lo"] <= y["lo"]) & (x["hi"] >= y["hi"]))


def covers(a: str, b: str) -> Column:
    """Whether the rule aliased ``a`` covers all that ``b`` does; unknown counts as no."""
    c = lambda side, name: F.col(f"{side}.{name}")
    local = c(a, "type") == "local"
    replication = F.array_contains(c(b, "dbs"), "replication")
    db = F.when(replication & ~local, F.array_contains(c(a, "dbs"), "replication") & (F.size(F.array_except(c(b, "dbs"), c(a, "dbs"))) == 0)).otherwise(_list_covers(c(a, "dbs"), c(b, "dbs")))
    return _type_covers(c(a, "type"), c(b, "type")) & db & _list_covers(c(a, "users"), c(b, "users")) & (local | F.coalesce(_address_covers(a, b), F.lit(False)))


def shadowing(rules: DataFrame) -> DataFrame:
    """Rules that never decide because of an earlier one: ``duplicate``, ``redundant`` or ``shadowed``.

    Rules are compared within their server; a server has some hundred at most.
    """
    p = prepared(rules)
    same = F.lit(True)
    for name in ("type", "database", "user", "address", "method"):
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    pairs = p.alias("a").hint("merge").join(p.alias("b"), (F.col("a.server") == F.col("b.server")) & (F.col("a.rule_no") < F.col("b.rule_no")) & (same | covers("a", "b")))
    code = F.when(same, "duplicate").when((F.col("a.method") == "reject") == (F.col("b.method") == "reject"), "redundant").otherwise("shadowed")
    found = pairs.groupBy(F.col("b.server").alias("server"), F.col("b.rule_no").alias("rule_no")).agg(F.min(F.struct(F.col("a.rule_no").alias("with_rule"), code.alias("code"))).alias("x"))
    return found.select("server", "rule_no", "x.*")


def first_match(needs: DataFrame, rules: DataFrame) -> DataFrame:
    """For each need (shaped as a rule) the first rule of its server that covers it, and its method."""
    n, p = prepared(needs.withColumnRenamed("rule_no", "need_no")), prepared(rules)
    met = p.alias("a").hint("merge").join(n.alias("b"), (F.col("a.server") == F.col("b.server")) & covers("a", "b"))
    hit = met.groupBy(F.col("b.server").alias("server"), F.col("b.need_no").alias("need_no")).agg(F.min(F.struct(F.col("a.rule_no").alias("rule_no"), F.col("a.method").alias("method"))).alias("x"))
    return needs.select("server", F.col("rule_no").alias("need_no")).join(hit, ["server", "need_no"], "left").select("server", "need_no", F.col("x.rule_no").alias("rule_no"), F.coalesce("x.method", F.lit("none")).alias("method"))


def ordered(rules: DataFrame, wide: bool = False) -> DataFrame:
    """Rules with ``place``, a safe order (L4): by type, narrow networks first (or last), rejections, then specific users and databases."""
    p = prepared(rules)
    kind = F.when(F.col("type") == "local", 0).when(F.col("type").isin("hostssl", "hostgssenc"), 1).when(F.col("type").isin("hostnossl", "hostnogssenc"), 2).otherwise(3)
    breadth = F.when((F.col("type") == "local") | (F.col("address") == "all"), 0).otherwise(F.coalesce("net.prefix", F.lit(30)))
    every = lambda c: F.array_contains(c, "all").cast("int")
    order = [kind, breadth if wide else -breadth, (F.col("method") != "reject").cast("int"), every("users"), every("dbs"), F.col("rule_no")]
    return p.withColumn("place", F.row_number().over(Window.partitionBy("server").orderBy(*order))).select("server", "rule_no", "place")


def is_pattern(token: Column) -> Column:
    """Whether a ``/pattern`` is a regular expression: the engine's own compiler says so, and its error is a no."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.substring(token, F.lit(2), F.length(token))).isNotNull()


def decisions(probes: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """What happens to each probe (``server``, ``probe``, ``database``, ``user``, ``ip``, ``ssl``): the first certain match decides.

    An earlier rule that cannot be judged is passed over and makes the answer ``uncertain``. No match
    is a refusal. ``members(role, user)`` resolves ``+role``; names that begin with ``/`` are
    patterns, and a rule with one that is no regular expression is one that cannot be judged.
    Probes may tell ``gss`` (encrypted by GSSAPI), else they are not.
    """
    p = prepared(rules).withColumnRenamed("server", "r_server").withColumn("faulty", F.filter(F.concat("dbs", "users"), lambda t: t.startswith("/") & ~is_pattern(t)))
    known = members.groupBy("user").agg(F.collect_set(F.concat(F.lit("+"), F.col("role"))).alias("roles"))
    asked = probes.join(known, "user", "left").withColumns({"at": network(F.col("ip"))["lo"], "roles": F.coalesce("roles", F.array().cast("array<string>"))})
    db, user = F.col("p.database"), F.col("p.user")
    gss = F.coalesce(F.col("p.gss"), F.lit(False)) if "gss" in probes.columns else F.lit(False)
    kind = F.when(F.col("r.type") == "hostssl", F.col("p.ssl")).when(F.col("r.type") == "hostnossl", ~F.col("p.ssl")).when(F.col("r.type") == "hostgssenc", gss).when(F.col("r.type") == "hostnogssenc", ~gss).otherwise(F.col("r.type") == "host")
    # A pattern is looked at only where it has been seen to be one; a faulty one makes the match unknown.
    like = lambda names, value: F.exists(names, lambda t: F.when(~t.startswith("/"), False).when(~F.array_contains("r.faulty", t), F.regexp_like(value, F.substring(t, F.lit(2), F.length(t)))))
    on_db = F.when(db == "replication", F.array_contains("r.dbs", "replication")).otherwise(F.array_contains("r.dbs", "all") | F.array_contains("r.dbs", db) | like(F.col("r.dbs"), db) | (F.array_contains("r.dbs", "sameuser") & (db == user)))
    on_user = F.array_contains("r.users", "all") | F.array_contains("r.users", user) | like(F.col("r.users"), user) | F.arrays_overlap("r.users", "p.roles")
    on_net = F.when(F.col("r.net").isNull(), None).otherwise((F.col("p.at") >= F.col("r.net.lo")) & (F.col("p.at") <= F.col("r.net.hi")))
    match = kind & on_db & on_user & on_net
    met = asked.alias("p").join(p.alias("r").hint("merge"), (F.col("p.server") == F.col("r.r_server")) & F.coalesce(kind & on_db & on_user, F.lit(True)))
    hits = met.select("p.server", "p.probe", "r.rule_no", "r.method", match.alias("hit")).filter("hit IS NULL OR hit")
    best = hits.groupBy("server", "probe").agg(F.min(F.when(F.col("hit"), F.struct("rule_no", "method"))).alias("x"), F.min(F.when(F.col("hit").isNull(), F.col("rule_no"))).alias("unknown"))
    out = probes.select("server", "probe").join(best, ["server", "probe"], "left")
    return out.select("server", "probe", F.col("x.rule_no").alias("rule_no"), F.coalesce("x.method", F.lit("refused")).alias("method"), F.coalesce(F.col("unknown") < F.coalesce("x.rule_no", F.lit(1 << 30)), F.lit(False)).alias("uncertain"))


def problems(rules: DataFrame) -> DataFrame:
    """Errors of single rules and duplicates with the first of their kind (X2); rules may have ``options``."""
    same = ["server", "type", "database", "user", "address", "method", *[c for c in ["options"] if c in rules.columns]]
    first = F.min("rule_no").over(Window.partitionBy(*same))
    wrong = F.when(~F.col("type").isin("local", "host", "hostssl", "hostnossl", "hostgssenc", "hostnogssenc"), "type").when((F.col("type") != "local") & (F.coalesce("address", F.lit("")) == ""), "address").when(F.col("address").rlike(r"^[\d.]+/\d+$|^[0-9a-fA-F:]*:[0-9a-fA-F:]*(/\d+)?$") & network(F.col("address")).isNull(), "network").when((F.col("method") == "trust") & (F.col("type") != "local") & ~F.coalesce("address", F.lit("")).isin(LOOPBACK), "trust")
    return rules.withColumns({"problem": wrong, "first": first}).select("server", "rule_no", "problem", F.when(F.col("first") < F.col("rule_no"), F.col("first")).alias("duplicate_of")).filter("problem IS NOT NULL OR duplicate_of IS NOT NULL")


def expired(rules: DataFrame, now: str) -> DataFrame:
    """Rules whose comment says ``[until=...Z]`` not after ``now`` (ISO text in UTC)."""
    return rules.withColumn("until", F.regexp_extract("comment", r"\[until=(\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d)?)Z\]", 1)).filter((F.col("until") != "") & (F.col("until") <= now))


def needs_of(nodes: DataFrame) -> DataFrame:
    """Rules that a server's nodes need of each other (X4): replication and administration, one for each network."""
    host = F.when(F.col("ip").contains(":"), F.concat("ip", F.lit("/128"))).otherwise(F.concat("ip", F.lit("/32")))
    return nodes.select("server", host.alias("address"), F.explode(F.array(F.lit("replication"), F.lit("admin"))).alias("purpose")).distinct()


def longest_prefix(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """The mount that holds each path (X7): all its parents are looked up, the longest one found wins."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    up = F.concat(F.array(F.lit("/")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    met = paths.select("host", "path", F.explode(F.array_distinct(up)).alias("mount")).join(mounts, ["host", "mount"])
    return met.groupBy("host", "path").agg(F.max_by("mount", F.length("mount")).alias("mount"))


def preferred(options: DataFrame, keys: list[str]) -> DataFrame:
    """The option of the least ``priority`` of each key (X8), the first by ``value`` on a tie."""
    return options.groupBy(*keys).agg(F.min(F.struct("priority", "value")).alias("x")).select(*keys, "x.value", "x.priority")
