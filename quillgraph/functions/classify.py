"""Classification ladders as columns. Word lists and orders are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operations from lowest to highest priority, in the two orders in use.
ROLL_UP_PRIORITY = ("COUNT", "AGGREGATE", "READ", "DELETE", "UPDATE", "WRITE", "CALL")
DETECT_PRIORITY = ("READ", "COUNT", "WRITE", "UPDATE", "DELETE", "AGGREGATE")
# Prefixes of method names by operation, in order of trial.
OP_PREFIXES: dict[str, tuple[str, ...]] = {
    "READ": ("find", "get", "read", "query", "search", "fetch", "load", "retrieve", "distinct", "stream", "scroll", "watch", "changeStream", "findById", "findOne", "findAll", "findAllById", "list", "select", "resolve", "lookup", "cursor", "toList", "iterate"),
    "WRITE": ("save", "insert", "persist", "create", "add", "store", "bulkWrite", "insertMany", "insertAll", "saveAll", "addInsert", "execute", "insertOne", "createCollection", "createIndex", "renameCollection", "ensureIndex", "putDocument", "writeDocument"),
    "UPDATE": ("update", "modify", "set", "patch", "edit", "change", "replace", "upsert", "updateMany", "updateFirst", "updateMulti", "findAndModify", "findAndReplace", "addUpdate", "replaceOne", "merge", "updateOne", "findOneAndUpdate", "findOneAndReplace", "increment", "mutate"),
    "DELETE": ("delete", "remove", "clear", "purge", "drop", "deleteMany", "deleteAll", "removeAll", "addDelete", "findAndRemove", "findAllAndRemove", "deleteOne", "findOneAndDelete", "dropCollection", "dropIndex"),
    "AGGREGATE": ("aggregate", "aggregation", "graphLookup", "pipeline", "mapReduce", "group", "bucket", "facet", "unwind", "bucketAuto", "unionWith", "out"),
    "COUNT": ("count", "exists", "countDocuments", "estimatedDocumentCount"),
}
# Ends of method names that have nothing to do with stored data, roles of data classes, and their accessors' prefixes.
OTHER_SUFFIXES = (
    "listener", "handler", "observer", "callback", "interceptor", "filter", "logger", "thread", "decorator", "factory", "builder", "validator", "view", "component", "panel", "frame", "dialog", "widget",
    "timer", "scheduler", "executor", "task", "runnable", "stream", "iterator", "comparator", "converter", "mapper", "savepoint", "checkpoint", "snapshot", "backup", "context", "scope", "session", "attribute", "header",
    "resource", "connection", "channel", "socket",
)
DATA_ROLES, ACCESSORS = ("ENTITY", "OTHER"), ("get", "set")
# Packages and functions that a database brings along.
BUILTIN_PREFIXES = ("DBMS_", "UTL_", "SYS.")
BUILTIN_PACKAGES = ("STANDARD", "APEX_JSON", "APEX_WEB_SERVICE", "HTF", "HTP", "OWA_UTIL")
BUILTIN_FUNCTIONS = (
    "NVL", "NVL2", "DECODE", "TO_CHAR", "TO_DATE", "TO_NUMBER", "TO_TIMESTAMP", "SUBSTR", "INSTR", "LENGTH", "REPLACE", "TRIM", "LTRIM", "RTRIM", "UPPER", "LOWER", "INITCAP", "LPAD", "RPAD",
    "ROUND", "TRUNC", "MOD", "ABS", "CEIL", "FLOOR", "POWER", "SQRT", "SYSDATE", "SYSTIMESTAMP", "CURRENT_DATE", "CURRENT_TIMESTAMP", "ADD_MONTHS", "MONTHS_BETWEEN", "LAST_DAY", "NEXT_DAY", "EXTRACT",
    "COALESCE", "NULLIF", "GREATEST", "LEAST", "CASE", "CAST", "COUNT", "SUM", "AVG", "MIN", "MAX", "LISTAGG", "ROW_NUMBER", "RANK", "DENSE_RANK", "ROWNUM", "ROWID", "RAISE_APPLICATION_ERROR",
    "SQL%ROWCOUNT", "SQL%FOUND", "SQL%NOTFOUND", "SQLCODE", "SQLERRM", "USER", "SYS_CONTEXT", "REGEXP_LIKE", "REGEXP_REPLACE", "REGEXP_SUBSTR", "REGEXP_INSTR", "XMLTYPE", "XMLELEMENT", "XMLFOREST",
    "XMLAGG", "XMLQUERY", "EXISTSNODE", "CONCAT",
)
# Segments of an archive's name that say nothing.
FILLER_SEGMENTS = ("extension", "core", "lib", "common", "shared", "service", "module", "app")
# Upper limits of size and performance classes.
SIZES = (("S", 5), ("M", 20), ("L", 50))
PERFORMANCE = (("No Impact", 0), ("Low Impact", 5), ("Medium Impact", 20))
BATCH_WORDS = ("batch", "job", "schedul", "cron", "async", "bulk", "process", "trigger", "task")


def ladder(value: Column, steps: tuple[tuple[str, int], ...], last: str) -> Column:
    """The first label whose limit the value does not exceed."""
    out = None
    for label, limit in steps:
        out = F.when(value <= limit, label) if out is None else out.when(value <= limit, label)
    return out.otherwise(last)


def size_class(methods: Column) -> Column:
    return ladder(methods, SIZES, "XL")


def perf_class(db_ops: Column) -> Column:
    return ladder(db_ops, PERFORMANCE, "High Impact")


def rank_of(op: Column, ranking: tuple[str, ...]) -> Column:
    """Place of an operation in an order, 0 if it is in none."""
    return F.coalesce(F.create_map(*[F.lit(x) for i, o in enumerate(ranking) for x in (o, i + 1)])[op], F.lit(0))


def normalized(identifier: Column) -> Column:
    """An identifier without quotes and outer blanks, upper-cased."""
    return F.upper(F.trim(F.regexp_replace(identifier, '"', "")))


def node_id(*parts: Column) -> Column:
    """Schema, package and object as one id; empty parts are left out, odd characters become underscores."""
    return F.regexp_replace(F.upper(F.concat_ws("$", *[F.nullif(p, F.lit("")) for p in parts])), "[^A-Z0-9_$]", "_")


def sql_operation(sql: Column) -> Column:
    """Operation by the leading keyword; null for none."""
    s = F.upper(F.ltrim(sql))
    out = None
    for words, op in ((("SELECT", "WITH"), "READ"), (("INSERT", "MERGE"), "WRITE"), (("UPDATE",), "UPDATE"), (("DELETE", "TRUNCATE"), "DELETE"), (("CALL", "{CALL", "{ CALL", "EXEC", "BEGIN"), "CALL")):
        hit = None
        for w in words:
            hit = s.startswith(w) if hit is None else hit | s.startswith(w)
        out = F.when(hit, op) if out is None else out.when(hit, op)
    return out


def op_from_name(name: Column, role: Column | None = None) -> Column:
    """Operation by method-name prefix, operations in order; null for names that end in another purpose. In a data class (a role in
    DATA_ROLES, or none) plain accessors are no operation; without ``role`` the class is taken for one that works on data."""
    low = F.lower(name)
    out = F.when(low.rlike("(%s)$" % "|".join(OTHER_SUFFIXES)), F.lit(None))
    data = F.lit(False) if role is None else role.isNull() | role.isin(*DATA_ROLES)
    begins = lambda words: low.rlike("^(%s)" % "|".join(w.lower() for w in words)) if words else F.lit(False)
    for op, prefixes in OP_PREFIXES.items():
        plain = begins([w for w in prefixes if w not in ACCESSORS])
        out = out.when(plain | (begins([w for w in prefixes if w in ACCESSORS]) & ~data), op)
    return out


def call_class(parts: Column, own_package: Column, members: Column, builtins: tuple[str, ...]) -> Column:
    """INTERNAL, BUILTIN or EXTERNAL by the arity of the name: a member of the caller's package is internal."""
    one = F.when(F.array_contains(members, F.element_at(parts, 1)), "INTERNAL").when(F.element_at(parts, 1).isin(*builtins), "BUILTIN").otherwise("EXTERNAL")
    two = F.when(F.element_at(parts, 1) == own_package, "INTERNAL").when(F.element_at(parts, 1).like("DBMS\\_%"), "BUILTIN").otherwise("EXTERNAL")
    return F.when(F.size(parts) == 1, one).when(F.size(parts) == 2, two).otherwise("EXTERNAL")


def edge_call_type(dynamic: Column, trigger: Column, target: Column, package: Column) -> Column:
    inside = (target == package) | target.startswith(F.concat(package, F.lit(".")))
    return F.when(dynamic, "DYNAMIC").when(trigger, "TRIGGER").when(inside, "INTERNAL").otherwise("EXTERNAL")


def join_type(text: Column) -> Column:
    """Kind of a join by its keywords; a comma join is IMPLICIT."""
    u, out = F.upper(text), None
    for pattern, kind in (
        (r"\bCROSS\s+APPLY\b", "CROSS APPLY"), (r"\bOUTER\s+APPLY\b", "OUTER APPLY"), (r"\bCROSS\s+JOIN\b", "CROSS"), (r"\bNATURAL\b", "NATURAL"), (r"\bFULL(\s+OUTER)?\s+JOIN\b", "FULL OUTER"),
        (r"\bLEFT(\s+OUTER)?\s+JOIN\b", "LEFT OUTER"), (r"\bRIGHT(\s+OUTER)?\s+JOIN\b", "RIGHT OUTER"), (r"\bJOIN\b", "INNER"),
    ):
        out = F.when(u.rlike(pattern), kind) if out is None else out.when(u.rlike(pattern), kind)
    return out.otherwise("IMPLICIT")


def unit_type(source: Column) -> Column:
    """Kind of program unit by the header of its source."""
    found = F.upper(F.regexp_extract(source, r"(?i)^\s*(?:create\s+(?:or\s+replace\s+)?)?(package\s+body|package|procedure|function|trigger|type\s+body|type|view)\b", 1))
    return F.when(found == "", "ANONYMOUS").otherwise(F.regexp_replace(found, r"\s+", "_"))


def trigger_timing(description: Column, type_name: Column) -> Column:
    """Timing by the description, else by the prefix of the type."""
    def of(c: Column) -> Column:
        u = F.upper(c)
        return F.when(u.contains("INSTEAD OF"), "INSTEAD OF").when(u.contains("BEFORE"), "BEFORE").when(u.contains("AFTER"), "AFTER")

    return F.coalesce(of(description), of(type_name))


def wrapped(source: Column) -> Column:
    """Wrapped source: the word, or a hexadecimal word of eight digits or more, near the start (any such number counts)."""
    return F.substring(source, 1, 300).rlike(r"(?i)(?<![A-Za-z0-9_])(wrapped|[0-9a-f]{8,})(?![A-Za-z0-9_])")  # an ASCII word, whatever \b takes for one


def likely_collection(name: Column) -> Column:
    return F.char_length(name).between(4, 60) & name.contains("_") & name.rlike("^[A-Z][A-Z0-9_]+$")


def variable_category(data_type: Column) -> Column:
    u = F.upper(data_type)
    return F.when(u.endswith("%ROWTYPE"), "ROWTYPE").when(u.endswith("%TYPE"), "TYPE").when(u.rlike(r"\b(TABLE|VARRAY)\b|^T_.*(TAB|LIST)$"), "COLLECTION").otherwise("PLAIN")


def view_name(name: Column) -> Column:
    """Whether a collection's name marks a view."""
    u = F.upper(name)
    return u.contains("_V_") | u.contains("_VI_") | u.startswith("SB_")


def archive_label(archive: Column) -> Column:
    """An archive's name without version, suffix and filler segments, its words capitalised."""
    words = F.split(F.regexp_replace(archive, r"(-\d[\d.]*(-SNAPSHOT)?)?\.jar$", ""), "-")
    return F.array_join(F.transform(F.filter(words, lambda x: ~F.lower(x).isin(*FILLER_SEGMENTS)), F.initcap), " ")


def builtin_package(name: Column) -> Column:
    """Whether a package is the database's own; null is not."""
    u = F.upper(name)
    hit = u.isin(*BUILTIN_PACKAGES)
    for prefix in BUILTIN_PREFIXES:
        hit = hit | u.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def builtin_function(name: Column) -> Column:
    """Whether a function is the database's own; null is not."""
    return F.coalesce(F.upper(name).isin(*BUILTIN_FUNCTIONS), F.lit(False))


def fires(event: Column, op: Column) -> Column:
    """Whether an operation fires a trigger of an event: a merge fires any, a query none."""
    return (op == "MERGE") | ((op != "SELECT") & F.upper(event).contains(op))
