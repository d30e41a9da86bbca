"""Facts of SQL change statements from column expressions: no parser, only patterns of whole statements.

A script is cut into tokens by one pattern that reads strings, quoted names, dollar-quoted texts and comments
from left to right, so each hides its own contents and nothing else. Comments become a space, the contents of
strings and of odd names are written as hex digits, and the rest is cut at its semicolons and exploded; lists of
dropped objects and of ALTER TABLE actions are exploded again. Each piece is matched as a whole, with what
stands in parentheses left out, by the patterns below, in order; a piece that none matches in full is
Unrecognized, which no rule calls safe. The body of a DO block or function is read back from its string and
examined the same way, ``DEPTH`` levels deep, deeper ones being beyond the limit. What cannot be told from text
(EXECUTE of an expression) counts as unresolved dynamic SQL. A script that cannot be SQL (an open quote or comment,
parentheses that do not match, a statement that begins with no command) has a parse fault and no verdict.

A script is cut into tokens once, in a job that deals the scripts to all cores and writes them to the shared folder with what
is wrong with them. Each level of bodies is one job that writes the facts of its statements; levels that no script has are not run.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .rules import apply_pairings, classify, first_later, severity, typed

_COMMENT = r"/\*[^*/]*+(?:(?:\*+(?![*/])|/(?!\*)%s)[^*/]*+)*+\*+/"
_NESTED = _COMMENT % ("|" + _COMMENT % ("|" + _COMMENT % ""))
#: Left to right: comments, strings, quoted names, dollar-quoted texts, runs of words and other plain signs, all else.
TOKEN = rf"""(?s)--[^\n]*+|{_NESTED}|[eE]'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|'[^']*+(?:''[^']*+)*+'|"[^"]*+(?:""[^"]*+)*+"|(\$(?:[A-Za-z_\x80-\uffff][\w\x80-\uffff]*+)?\$).*?\1|(?:(?![eE]')[\w\x80-\uffff][\w$\x80-\uffff]*+|[^\w\x80-\uffff'"$/-]++|-(?!-)|/(?!\*))++|."""
#: Stands for a quote or comment without an end.
_OPEN = "\x01"
#: Levels of bodies that are examined, and of parentheses that are told apart.
DEPTH, PARENTHESES = 8, 8

PART = r'(?:"[^"]+"|[a-z_\x80-\uffff][\w$\x80-\uffff]*)'
NAME = rf"{PART}(?:\s*\.\s*{PART}){{0,2}}"
STRING = r"'[0-9a-f]*'"
LANGUAGE = rf'language (?:"?\w+"?|{STRING})'
#: Functions by how a default calls them.
VOLATILE = ("clock_timestamp", "statement_timestamp", "transaction_timestamp", "random", "random_normal", "gen_random_uuid", "uuid_generate_v4", "nextval", "txid_current", "pg_backend_pid")
STABLE = ("now", "current_timestamp", "current_date", "current_time", "localtimestamp")
IMMUTABLE = ("md5", "length")

_TABLE = rf"alter table (?:if exists )?(?:only )?({NAME})"
#: statementKind and the pattern of a whole statement, lower-cased, parentheses emptied; the first that matches counts.
PATTERNS: list[tuple[str, str]] = [
    ("DropTable", rf"drop table (?:if exists )?({NAME})(?: cascade| restrict)?"),
    ("DropSchema", rf"drop schema (?:if exists )?({NAME})(?: cascade| restrict)?"),
    ("DropDatabase", rf"drop database (?:if exists )?({NAME}).*"),
    ("DropIndex", rf"drop index (?:concurrently )?(?:if exists )?({NAME})(?: cascade| restrict)?"),
    ("Truncate", rf"truncate (?:table )?(?:only )?({NAME}).*"),
    ("Delete", rf"delete from (?:only )?({NAME}).*"),
    ("Update", rf"update (?:only )?({NAME}).* set .*"),
    ("CreateTable", rf"create (?:temp |temporary |unlogged )?table (?:if not exists )?({NAME}) ?\(\)(?: (?:inherits|partition by|using|with|without|on commit|tablespace)\b(?!.*\bas\b).*)?"),
    ("CreateTable", rf"create (?:temp |temporary |unlogged )?table (?:if not exists )?({NAME}) partition of .*"),
    ("CreateIndex", rf"create (?:unique )?index (?:concurrently )?(?:if not exists )?(?:{NAME} )?on (?:only )?({NAME}).*"),
    ("RenameColumn", rf"alter table (?:if exists )?(?:only )?({NAME}) rename (?:column )?(?!to |constraint ){NAME} to {NAME}"),
    ("RenameTable", rf"alter table (?:if exists )?({NAME}) rename to {NAME}"),
    ("DropColumn", rf"{_TABLE} drop (?!constraint)(?:column )?(?:if exists )?{NAME}(?: cascade| restrict)?"),
    ("AddUniqueConstraint", rf"{_TABLE} add (?:constraint {NAME} )?unique\b.*"),
    ("AddCheckConstraint", rf"{_TABLE} add (?:constraint {NAME} )?check\b.*"),
    ("AddForeignKey", rf"{_TABLE} add (?:constraint {NAME} )?foreign key\b.*"),
    ("DropConstraint", rf"{_TABLE} drop constraint (?:if exists )?{NAME}(?: cascade| restrict)?"),
    ("ValidateConstraint", rf"{_TABLE} validate constraint {NAME}"),
    ("SetNotNull", rf"{_TABLE} alter (?:column )?{NAME} set not null"),
    ("DropNotNull", rf"{_TABLE} alter (?:column )?{NAME} drop not null"),
    ("AlterColumnType", rf"{_TABLE} alter (?:column )?{NAME} (?:set data )?type .*"),
    ("AddColumn", rf"{_TABLE} add (?!(?:constraint|primary|unique|foreign|check|exclude)\b)(?:column )?(?:if not exists )?{NAME} .*"),
    ("CommentOn", r"comment on .*"),
    ("DoBlock", rf"do (?:{LANGUAGE} )?{STRING}(?: {LANGUAGE})?"),
    ("CreateFunction", r"create (?:or replace )?(?:function|procedure) .*"),
    ("Vacuum", r"vacuum\b.*"),
    ("AlterSystem", r"alter system .*"),
    ("CreateDatabase", r"create database .*"),
    ("Reindex", r"reindex\b.*"),
    ("AlterDatabaseSet", r"alter database .* (?:set|reset) .*"),
    ("AlterRoleSet", r"alter (?:role|user) .* (?:set|reset) .*"),
    ("SetGuc", r"(?:set|reset) .*"),
]
#: Pieces of a procedural body that run no statement.
_INERT = r"|end|end (?:if|loop|case|[\w\"]+)(?: [\w\"]+)?|if .*|elsif .*|elseif .*|for .*|foreach .*|while .*|return\b.*|raise\b.*|perform .*|null|exit\b.*|continue\b.*|exception when .*|case .*|when .*|assert .*|get (?:current |stacked )?diagnostics .*|open .*|fetch .*|move .*|close .*|commit|rollback|(?:<<\w+>> ?)+|[\w.\"\[\]]+ *:?= *.*"
_DECLARATION = r"\w+ (?:constant )?[\w.%()\[\], \"]+(?:(?::=|=|\bdefault\b).*)?"
_KNOWN = r"(?:drop|truncate|delete|update|create|alter|comment|execute|vacuum|reindex|set|reset|insert|grant|revoke)\b.*"


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def tokens(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))


def cleaned(tokens: Column) -> Column:
    """Lower-cased, without comments and repeated white space; strings and odd names as hex digits in their quotes."""

    def hexed(c: Column) -> Column:
        return F.lower(F.hex(c.cast("binary")))

    def inside(t: Column, before: int) -> Column:
        return F.substr(t, F.lit(before + 1), F.length(t) - before - 1)

    def shown(t: Column) -> Column:
        tag = F.regexp_extract(t, r"^\$[^$]*\$", 0)
        escaped = F.regexp_replace(F.regexp_replace(F.replace(inside(t, 2), F.lit("''"), F.lit("'")), r"\\n", "\n"), r"(?s)\\(.)", "$1")
        name = F.replace(inside(t, 1), F.lit('""'), F.lit('"'))
        return (
            F.when(t.startswith("--") | t.startswith("/*"), " ")
            .when(t.rlike("^[eE]'"), F.concat(F.lit("'"), hexed(escaped), F.lit("'")))
            .when(t.startswith("'") & (F.length(t) > 1), F.concat(F.lit("'"), hexed(F.replace(inside(t, 1), F.lit("''"), F.lit("'"))), F.lit("'")))
            .when((tag != "") & (F.length(t) > 1), F.concat(F.lit("'"), hexed(F.substr(t, F.length(tag) + 1, F.length(t) - 2 * F.length(tag))), F.lit("'")))
            .when(t.startswith('"') & (F.length(t) > 1), F.concat(F.lit('"'), F.when(name.rlike(r"^[a-z_][a-z0-9_$]*$"), name).otherwise(F.concat(F.lit("0"), hexed(name))), F.lit('"')))
            .when(t.isin("'", '"', "$"), _OPEN)
            .otherwise(F.lower(t))
        )

    text = F.array_join(F.transform(tokens, shown), "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"/\*", _OPEN), r"\s+", " "))


def flattened(text: Column) -> Column:
    """``text`` with what stands between parentheses left out; deeper ones than PARENTHESES stay open."""
    flat = text
    for _ in range(PARENTHESES):
        flat = F.regexp_replace(flat, r"\([^()]*\)", "\x02")
    return F.when(text.contains("(") | text.contains("\x02"), F.regexp_replace(flat, "\x02", "()")).otherwise(text)


#: Words that a statement of the dialect can begin with.
COMMANDS = (
    "abort", "alter", "analyse", "analyze", "begin", "call", "checkpoint", "close", "cluster", "comment", "commit", "copy", "create", "deallocate", "declare", "delete", "discard", "do", "drop", "end",
    "execute", "explain", "fetch", "grant", "import", "insert", "listen", "load", "lock", "merge", "move", "notify", "prepare", "reassign", "refresh", "reindex", "release", "reset", "revoke", "rollback",
    "savepoint", "security", "select", "set", "show", "start", "table", "truncate", "unlisten", "update", "vacuum", "values", "with",
)


def masked(tokens: Column) -> Column:
    """A text of the same length, lower-cased, with comments as spaces and strings and quoted names as letters x."""
    same = lambda letter, t: F.repeat(F.lit(letter), F.length(t))
    shown = lambda t: F.when(t.startswith("--") | (t.startswith("/*") & (F.length(t) > 3)), same(" ", t)).when((F.length(t) > 1) & t.rlike(r"""^(?:[eE]?'|"|\$)"""), same("x", t)).otherwise(F.lower(t))
    return F.array_join(F.transform(tokens, shown), "")


def spans(mask: Column) -> Column:
    """array<struct<location, length>> of the top-level statements of a masked text: from the first to the last sign of each.

    A body that begins with BEGIN ATOMIC belongs to its statement up to its bare END. Blank statements are none.
    """
    none = F.array().cast("array<struct<start:int,stop:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("begin"), F.lit(False).alias("inside"), none.alias("out"))

    def step(acc: Column, part: Column) -> Column:
        word = F.regexp_replace(part, r"^\s+|\s+$", "")
        opens = ~acc["inside"] & word.rlike(r"(?s)^create\s+(?:or\s+replace\s+)?(?:function|procedure)\s.*\bbegin\s+atomic\b")
        closes = acc["inside"] & (word == "end")
        begin, stop = F.when(acc["inside"], acc["begin"]).otherwise(acc["at"]), acc["at"] + F.length(part)
        done = F.concat(acc["out"], F.array(F.struct(begin.alias("start"), stop.alias("stop"))))
        open_now = (acc["inside"] | opens) & ~closes
        return F.struct((stop + 1).alias("at"), begin.alias("begin"), open_now.alias("inside"), F.when(open_now, acc["out"]).otherwise(done).alias("out"))

    def finish(acc: Column) -> Column:
        rest = F.array(F.struct(acc["begin"].alias("start"), (acc["at"] - 1).alias("stop")))
        return F.when(acc["inside"], F.concat(acc["out"], rest)).otherwise(acc["out"])

    cut = F.aggregate(F.split(mask, ";"), start, step, finish)

    def tight(x: Column) -> Column:
        part = F.substr(mask, x["start"] + 1, x["stop"] - x["start"])
        lead = F.length(part) - F.length(F.regexp_replace(part, r"^\s+", ""))
        return F.struct((x["start"] + lead).alias("location"), F.length(F.regexp_replace(part, r"^\s+|\s+$", "")).alias("length"))

    return F.filter(F.transform(cut, tight), lambda x: x["length"] > 0)


def _computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once: behind a generator no later expression repeats theirs.

    Each call also becomes a method of its own in the code that Spark generates. The JVM compiles none of more than 8000 bytes,
    so long lists of columns are computed in several calls.
    """
    once = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return rows.select("*", once.alias("_once")).select("*", "_once.*").drop("_once")


def _spanned(scripts: DataFrame) -> DataFrame:
    """file, sql, tokens, mask, spans, each computed once."""
    rows = scripts.select("file", F.coalesce(F.col("sql"), F.lit("")).alias("sql"))
    rows = _computed(rows, tokens=tokens(F.col("sql")))
    return _computed(_computed(rows, mask=masked(F.col("tokens"))), spans=spans(F.col("mask")))


def split_statements(scripts: DataFrame) -> DataFrame:
    """file, statement_index, location, length, text of each script's top-level statements, without semicolons and the comments between them.

    location counts characters from 0. A script of blanks and comments alone has none. Rows are split where they are, without a shuffle.
    """
    cut = _spanned(scripts).select("file", "sql", F.posexplode("spans").alias("statement_index", "x"))
    return cut.select("file", "statement_index", "x.location", "x.length", F.substr("sql", F.col("x.location") + 1, F.col("x.length")).alias("text"))


def judged(scripts: DataFrame) -> DataFrame:
    """file, sql, clean, fault: struct<at_character, reason> of the first thing for which a script cannot be SQL, null if none is seen."""
    mask = F.col("mask")
    fault = lambda at, reason: F.struct(at.cast("int").alias("at_character"), F.lit(reason).alias("reason"))
    rows = _computed(_spanned(scripts), opened=F.regexp_instr(mask, F.lit(r"""['"]|/\*|\$(?:[a-z_\x80-\uffff][\w\x80-\uffff]*)?\$""")))
    parts = F.transform("spans", lambda x: F.struct(x["location"].alias("location"), x["length"].alias("length"), F.substr(mask, x["location"] + 1, x["length"]).alias("text")))
    rows = _computed(rows, parts=parts)

    def of_statement(x: Column) -> Column:
        count = lambda sign: F.length(x["text"]) - F.length(F.replace(x["text"], F.lit(sign), F.lit("")))
        return (
            F.when(~F.regexp_extract(x["text"], r"^\(*\s*([a-z]*)", 1).isin(*COMMANDS), fault(x["location"] + 1, "no command"))
            .when(count("(") != count(")"), fault(x["location"] + x["length"], "parentheses do not match"))
            .when(x["text"].rlike(r"(?s)^alter\s+type\s.*\sdrop\s+value\b"), fault(x["location"] + 1, "values of a type cannot be dropped"))
        )

    first = F.get(F.filter(F.transform("parts", of_statement), lambda x: x.isNotNull()), F.lit(0))
    return rows.select("file", "sql", cleaned(F.col("tokens")).alias("clean"), F.when(F.col("opened") > 0, fault(F.col("opened"), "open quote or comment")).otherwise(first).alias("fault"))


def read(scripts: DataFrame) -> DataFrame:
    """``judged`` written once. Scripts are short and their reading is long, so a few files of them are dealt to all cores first."""
    spark = scripts.sparkSession
    return written(judged(scripts.repartition(max(32, 4 * spark.sparkContext.defaultParallelism), "file")), "judged")


def _pieces(rows: DataFrame) -> DataFrame:
    """One row per dropped object and per action of ALTER TABLE, each with the head of its statement."""
    head = F.regexp_extract("text", r"^(drop (?:table|schema|index) (?:concurrently )?(?:if exists )?)", 1)
    drop = F.regexp_extract("text", r"^(drop (?:table|schema|index) (?:concurrently )?(?:if exists )?)(.*?)((?: cascade| restrict)?)$", 2)
    alter = F.regexp_extract("text", rf"^(alter table (?:if exists )?(?:only )?{NAME}(?: ?\*)? )", 1)
    # A comma separates actions if the parentheses behind it are balanced.
    balanced = "[^()]*+"
    for _ in range(PARENTHESES - 1):
        balanced = rf"[^()]*+(?:\({balanced}\)[^()]*+)*+"
    actions = F.split(F.substr("text", F.length(alter) + 1), rf", ?(?={balanced}$)")
    found = (
        F.when(head != "", F.transform(F.split(drop, " ?, ?"), lambda x: F.concat(head, x))).when(alter != "", F.transform(actions, lambda x: F.concat(F.replace(alter, F.lit("*"), F.lit("")), F.trim(x)))).otherwise(F.array("text"))
    )
    rows = _computed(rows.withColumnRenamed("text", "whole").withColumn("text", F.col("whole")), found=found).drop("text", "whole")
    rows = rows.select("*", F.posexplode("found").alias("k", "text"))
    at = F.when(F.size("found") > 1, F.concat("at", F.array("k"))).otherwise(F.col("at"))
    return rows.withColumn("text", F.trim(F.when(F.col("text").contains("  "), F.regexp_replace("text", " +", " ")).otherwise(F.col("text")))).withColumns({"position": F.concat("position", F.array("k")), "at": at}).drop("k", "found")


def _told(rows: DataFrame) -> DataFrame:
    """rows with flat, kind, language, and body: the text of a container's body, null where it has none that can be read."""
    flat = F.col("flat")
    quoted = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    # The words that a pattern begins with are looked for first, which spares most patterns.
    begins = {p: re.match("[a-z ]*", p)[0] for _, p in PATTERNS}
    kind = F.expr("CASE " + " ".join(f"WHEN startswith(flat, '{begins[p]}') AND flat RLIKE {quoted(whole(p))} THEN '{name}'" for name, p in PATTERNS) + " ELSE 'Unrecognized' END")
    kind = F.when(F.col("text").contains(_OPEN) | flat.rlike(r"\((?!\))|(?<!\()\)"), "Unrecognized").when(F.col("procedural") & flat.rlike(r"^execute\b"), "ExecuteDynamic").otherwise(kind)
    # A parameter may be called language too: it stands in parentheses. Where none is named it is a procedural one.
    named, written = F.regexp_extract(flat, r'\blanguage "?(\w+)', 1), F.regexp_extract(flat, rf"\blanguage ({STRING})", 1)
    language = F.when(written != "", F.lower(F.unhex(F.replace(written, F.lit("'"), F.lit(""))).cast("string"))).when(named != "", named).otherwise("plpgsql")
    told = _computed(_computed(rows, flat=flattened(F.col("text"))), kind=kind, language=language)
    held = (
        F.when(~F.col("language").isin("plpgsql", "sql"), None)
        .when(F.col("kind") == "DoBlock", F.regexp_extract(flat, rf"^do (?:{LANGUAGE} )?'([0-9a-f]*)'", 1))
        .when((F.col("kind") == "CreateFunction") & flat.rlike(rf"\bas ?{STRING}"), F.regexp_extract(flat, r"\bas ?'([0-9a-f]*)'", 1))
    )
    return _computed(told, body=F.unhex(held).cast("string"))


def _top(scripts: DataFrame) -> DataFrame:
    """file, position, at, text, procedural, context, depth: statements of scripts and of BEGIN ATOMIC bodies, in order.

    position is unique and in order; at counts statements (and those of a body) from 0. Scripts without such a body are cut where they are.
    """
    atomic = F.col("clean").contains("begin atomic")
    parts = F.filter(F.transform(F.split("clean", ";"), lambda x: F.trim(x)), lambda x: x != "")
    plain = scripts.where(~atomic).select("file", F.posexplode(parts).alias("i", "text"))
    plain = plain.select("file", F.array("i").alias("position"), F.array("i").alias("at"), "text", F.lit(False).alias("procedural"), F.lit("top-level").alias("context"), F.lit(0).alias("depth"))
    return plain.unionByName(_top_atomic(scripts.where(atomic)))


def _top_atomic(scripts: DataFrame) -> DataFrame:
    rows = scripts.select("file", F.posexplode(F.split("clean", ";")).alias("i", "text")).withColumn("text", F.trim("text")).where("text <> ''")
    # Such a body's statements end with semicolons of their own, and it ends with a bare END.
    before = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("text").rlike(r"^create (?:or replace )?(?:function|procedure) .*\bbegin atomic\b"), F.col("i"))
    began, ended = F.last(opens, True).over(before), F.last(F.when(F.col("text") == "end", F.col("i")), True).over(before)
    rows = rows.withColumn("within", F.when(began > F.coalesce(ended, F.lit(-1)), began)).where("NOT (within IS NOT NULL AND text = 'end')")
    first = F.regexp_extract("text", r"^(.*?\bbegin atomic\b) ?(.*)$", 2)
    both = F.when(opens.isNotNull() & F.col("within").isNull(), F.array(F.struct(F.array("i").alias("position"), F.regexp_extract("text", r"^(.*?\bbegin atomic\b)", 1).alias("text")), F.struct(F.array(F.col("i"), F.lit(0), F.lit(0)).alias("position"), first.alias("text"))))
    both = both.otherwise(F.array(F.struct(F.when(F.col("within").isNull(), F.array("i")).otherwise(F.array(F.col("within"), F.lit(0), F.col("i"))).alias("position"), F.col("text").alias("text"))))
    rows = rows.select("file", F.explode(both).alias("x")).select("file", "x.position", "x.text").where("text <> ''")
    whole_statement, nested = F.col("position")[0], F.size("position") > 1
    number = (F.dense_rank().over(Window.partitionBy("file").orderBy(whole_statement)) - 1).cast("int")
    inner = (F.row_number().over(Window.partitionBy("file", whole_statement).orderBy("position")) - 2).cast("int")
    at = F.when(nested, F.array(number, inner)).otherwise(F.array(number))
    return rows.select("file", "position", at.alias("at"), "text", F.lit(False).alias("procedural"), F.when(nested, "function-body").otherwise("top-level").alias("context"), F.when(nested, 1).otherwise(0).alias("depth"))


def _inner(rows: DataFrame) -> DataFrame:
    """Statements of the bodies of containers, without what runs none."""
    context = F.when(F.col("kind") == "DoBlock", "do-block").otherwise("function-body")
    held = rows.where("body IS NOT NULL").select("file", "position", "at", "body", (F.col("language") == "plpgsql").alias("procedural"), context.alias("context"), (F.col("depth") + 1).alias("depth"))
    held = _computed(held, clean=cleaned(tokens(F.col("body")))).drop("body")
    text = plain = F.col("clean")
    for _ in range(3):  # expressions, innermost first: a CASE statement has semicolons inside
        plain = F.regexp_replace(plain, r'(?<!")\bcase\b(?:(?!\bcase\b|;).)*?\bend\b(?!"| case\b| if\b| loop\b)', "a_case")
    words = F.regexp_replace(F.regexp_replace(plain, r'(?<!")\b(declare|begin)\b(?!")', ";$1;"), r'(?<!")\b(then|else|loop)\b(?!")', ";")
    cut = held.select("file", "position", "at", "procedural", "context", "depth", F.posexplode(F.split(F.when(F.col("procedural"), words).otherwise(text), ";")).alias("j", "text")).withColumn("text", F.trim("text"))
    # Only what stands between DECLARE and BEGIN can be a declaration; a DECLARE inside a statement opens nothing.
    by = Window.partitionBy("file", "position").orderBy("j")
    begins = F.coalesce(F.lag("text").over(by), F.lit("")).rlike("^(<<.*>>)?$")
    word = F.when(F.col("procedural") & F.col("text").isin("declare", "begin") & begins, F.col("text"))
    before = F.last("word", True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("word", True).over(by.rowsBetween(0, Window.unboundedFollowing))
    cut = cut.withColumn("word", word).withColumn("declaring", before.eqNullSafe("declare") & after.eqNullSafe("begin")).where("word IS NULL AND text <> ''")
    silent = F.col("procedural") & (F.col("text").rlike(whole(_INERT)) | (F.col("declaring") & F.col("text").rlike(whole(_DECLARATION)))) & ~F.col("text").rlike(whole(_KNOWN))
    left = cut.where(~silent).withColumn("number", (F.row_number().over(by) - 1).cast("int"))
    return left.select("file", F.concat("position", F.array("j")).alias("position"), F.concat("at", F.array("number")).alias("at"), "text", "procedural", "context", "depth")


def _named(c: Column) -> Column:
    """A name as it was written: quoted odd ones are read back from their hex digits."""
    bare = F.nullif(F.replace(c, F.lit('"'), F.lit("")), F.lit(""))
    return F.when(bare.startswith("0"), F.unhex(F.substr(bare, F.lit(2))).cast("string")).otherwise(bare)


_ALTERS = ("DropColumn", "AddUniqueConstraint", "AddCheckConstraint", "AddForeignKey", "DropConstraint", "ValidateConstraint", "SetNotNull", "DropNotNull", "AlterColumnType", "AddColumn", "RenameColumn", "RenameTable")
#: Where a kind's statement names the object it works on.
_OBJECTS: list[tuple[tuple[str, ...], str]] = [
    (_ALTERS, rf"^alter table (?:if exists )?(?:only )?({NAME})"),
    (("DropTable", "DropSchema"), rf"^drop (?:table|schema) (?:if exists )?({NAME})"),
    (("DropIndex",), rf"^drop index (?:concurrently )?(?:if exists )?({NAME})"),
    (("DropDatabase",), rf"^drop database (?:if exists )?({NAME})"),
    (("Truncate",), rf"^truncate (?:table )?(?:only )?({NAME})"),
    (("Delete",), rf"^delete from (?:only )?({NAME})"),
    (("Update",), rf"^update (?:only )?({NAME})"),
    (("CreateTable",), rf"^create (?:temp |temporary |unlogged )?table (?:if not exists )?({NAME})"),
    (("CreateIndex",), rf"^create .*? on (?:only )?({NAME})"),
    (("CommentOn",), rf"^comment on (?:[a-z]+ )+?({NAME})(?: on {NAME})? is\b"),
    (("Vacuum",), rf"^vacuum (?:\(\) )?(?:(?:full|freeze|verbose|analyze) )*({NAME})$"),
]
_COLUMNS: list[tuple[tuple[str, ...], str]] = [
    (("AddColumn",), rf" add (?:column )?(?:if not exists )?({PART})"),
    (("DropColumn",), rf" drop (?:column )?(?:if exists )?({PART})"),
    (("SetNotNull", "DropNotNull", "AlterColumnType"), rf" alter (?:column )?({PART})"),
    (("RenameColumn",), rf" rename (?:column )?({PART}) to "),
]


def _of_kind(found: list[tuple[tuple[str, ...], str]]) -> Column:
    """What the pattern of a row's kind finds in it; no kind stands in two of a list's rows."""
    out = F
    for kinds, p in found:
        out = out.when(F.col("kind").isin(*kinds), F.regexp_extract("flat", p, 1))
    return out


def facts(rows: DataFrame) -> DataFrame:
    """rows with fact: all facts by name."""
    text, flat, kind = F.col("text"), F.col("flat"), F.col("kind")
    # A default is a function or a literal only if that, casts aside, is all of it.
    rest = r'(?: ?:: ?[\w ."]+(?: ?\(\))?(?: ?\[\d*\])*)*(?: (?:not null|null|primary key|unique|check|references|constraint|collate|generated)\b.*)?$'
    default, called = F.col("default"), F.regexp_extract("default", r'^(?:"?\w+"? ?\. ?)*"?(\w+)"? ?\(\)' + rest, 1)
    volatility = (
        F.when(called.isin(*VOLATILE), "volatile")
        .when(called.isin(*STABLE), "stable")
        .when(called.isin(*IMMUTABLE), "immutable")
        .when(default.rlike(rf"^(?:(?:(?:date|time|timestamp|timestamptz|interval) )?{STRING}|[-+]?\d[\d.]*(?:e[-+]?\d+)?|true|false|null)" + rest), "literal")
        .otherwise("unknown-function")
    )
    settings = kind.isin("SetGuc", "AlterSystem", "AlterDatabaseSet", "AlterRoleSet")
    atomic = flat.rlike(r"\bbegin atomic\b") & F.col("language").isin("plpgsql", "sql")
    concurrently = flat.rlike(r"\bconcurrently\b") | ((kind == "Reindex") & text.rlike(r"^reindex ?\([^()]*\bconcurrently\b"))
    proves = rf"\bcheck ?\( ?\(? ?({PART}) is not null ?\)? ?\)"
    added = kind.isin("AddUniqueConstraint", "AddCheckConstraint", "AddForeignKey", "DropConstraint", "ValidateConstraint")
    rows = _computed(
        rows,
        default=F.when(kind == "AddColumn", F.regexp_extract(flat, r" default (.*)$", 1)),
        object=_of_kind(_OBJECTS),
        target=_of_kind(_COLUMNS).when(kind == "AddCheckConstraint", F.regexp_extract(text, proves, 1)),
        constraint=F.when(added, F.regexp_extract(flat, rf" (?:add|drop|validate) constraint (?:if exists )?({PART})", 1)),
        built=F.when(kind == "CreateIndex", F.regexp_extract(flat, rf"index (?:concurrently )?(?:if not exists )?({PART}) on ", 1)),
        using=F.when(kind == "AddUniqueConstraint", F.regexp_extract(flat, rf"using index ({PART})", 1)),
        alone=kind.isin("CreateIndex", "DropIndex", "Reindex") & concurrently,
    )
    given = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    rows = rows.select(*[given(c) if c in ("default", "object", "target") else c for c in rows.columns])
    rows = _computed(rows, path=F.split("object", r"\s*\.\s*"))
    last, before = F.element_at("path", -1), F.try_element_at("path", F.lit(-2))
    named = {
        "statementKind": kind,
        "schema": _named(F.when(kind == "DropSchema", last).when(~kind.isin("DropDatabase", "Vacuum"), before)),
        "table": _named(F.when(~kind.isin("DropSchema", "DropIndex"), last)),
        "column": _named(F.col("target")),
        "constraintName": _named(F.col("constraint")),
        "indexName": _named(F.when(kind == "DropIndex", last).otherwise(F.col("built"))),
        "usingIndexName": _named(F.col("using")),
        "concurrently": F.col("alone"),
        "notValid": kind.isin("AddCheckConstraint", "AddForeignKey") & flat.rlike(r"\bnot valid$"),
        "checkProvesNotNull": (kind == "AddCheckConstraint") & F.col("target").isNotNull(),
        "defaultVolatility": F.when(default.isNull(), "none").otherwise(volatility),
        "hasWhereClause": kind.isin("Delete", "Update") & F.regexp_replace(flat, '"[^"]*"', '""').rlike(r"\bwhere\b"),
        "dynamicSqlUnresolved": kind == "ExecuteDynamic",
        "sourceContext": F.col("context"),
        "nestingDepth": F.col("depth"),
        "nestingLimitExceeded": F.col("beyond"),
        "bodyInspected": F.col("body").isNotNull() | ((kind == "CreateFunction") & F.coalesce(atomic, F.lit(False))),
        "transactionHostile": F.col("alone") | kind.isin("Vacuum", "AlterSystem", "CreateDatabase"),
        "disarmsTimeout": settings & flat.rlike(r'\b(?:set|reset) (?:local |session )?"?(?:lock_timeout|statement_timeout|all)\b'),
    }
    names = ("schema", "table", "column", "constraintName", "indexName", "usingIndexName")
    rows = _computed(rows, **{f: named[f] for f in names})
    return _computed(rows, fact=F.struct(*[(F.col(f) if f in names else c).alias(f) for f, c in named.items()]))


def typed_facts(told: DataFrame) -> DataFrame:
    """told with facts: the typed map of ``fact`` that rules are matched against."""
    held = list(told.schema["fact"].dataType)
    of = lambda some: F.create_map(*[x for f in some for x in (F.lit(f.name), typed(F.col(f"fact.{f.name}"), {"boolean": "b", "int": "i"}.get(f.dataType.simpleString(), "s")))])
    halves = _computed(_computed(told, some=of(held[: len(held) // 2])), others=of(held[len(held) // 2 :]))
    return halves.withColumn("facts", F.map_concat("some", "others")).drop("some", "others")


#: Kinds whose data loss no pairing lowers (deletes and updates only without a condition).
FLOOR = ("DropTable", "DropSchema", "DropDatabase", "Truncate", "DropColumn", "AlterTypeDropValue")


def pairs(rows: DataFrame) -> DataFrame:
    """file, position, partner, number, pass, rule_id of statements that together are safe; number is the partner's in its script.

    A constraint added NOT VALID and the next one that validates it on its table; an index built
    concurrently and the next constraint that uses it; a validated check that a column is not null and
    the next SET NOT NULL of that column, of which only the latter gains.
    """
    told = rows.select("file", "position", F.col("at")[0].alias("number"), "kind", *(F.col(f"fact.{f}").alias(f) for f in ("table", "column", "constraintName", "indexName", "usingIndexName", "concurrently", "notValid")))
    keys = ["file", "pass", "owner", "name"]
    own = lambda number, owner, name: [F.lit(number).alias("pass"), owner.alias("owner"), name.alias("name")]
    table, constraint, none = F.col("table"), F.col("constraintName"), F.lit("")
    added = told.where(F.col("notValid") & constraint.isNotNull()).select("file", *own(1, table, constraint), "position", "number", F.when(F.col("kind") == "AddCheckConstraint", F.col("column")).alias("column"))
    built = told.where((F.col("kind") == "CreateIndex") & F.col("concurrently") & F.col("indexName").isNotNull()).select("file", *own(2, none, F.col("indexName")), "position", "number", F.lit(None).cast("string").alias("column"))
    valid = told.where("kind = 'ValidateConstraint'").select("file", *own(1, table, constraint), "position", "number")
    used = told.where("kind = 'AddUniqueConstraint' AND usingIndexName IS NOT NULL").select("file", *own(2, none, F.col("usingIndexName")), "position", "number")
    met = first_later(added.unionByName(built), valid.unionByName(used), keys, "position")
    proven = met.where("column IS NOT NULL").select("file", "owner", "column", "position", "number")
    third = first_later(proven, told.where("kind = 'SetNotNull'").select("file", table.alias("owner"), "column", "position"), ["file", "owner", "column"], "position")
    rule = F.when(F.col("pass") == 1, "pair-not-valid-validated").otherwise("pair-concurrent-index-unique").alias("rule_id")
    sides = F.explode(F.array(F.struct("position", F.col("later_position").alias("partner"), F.col("later_number").alias("number")), F.struct(F.col("later_position").alias("position"), F.col("position").alias("partner"), "number"))).alias("x")
    both = met.select("file", "pass", rule, sides).select("file", "x.position", "x.partner", "x.number", "pass", "rule_id")
    gained = third.select("file", F.col("later_position").alias("position"), F.col("position").alias("partner"), "number", F.lit(3).alias("pass"), F.lit("pair-validated-check-set-not-null").alias("rule_id"))
    return both.unionByName(gained)


def _facts_of(rows: DataFrame) -> DataFrame:
    """file, position, at, kind, language, body, depth, fact."""
    return facts(rows).select("file", "position", "at", "kind", "language", "body", "depth", "fact")


def _examined(scripts: DataFrame) -> DataFrame:
    """file, position (array), at, kind, fact of all statements of scripts (file, clean) and of the bodies inside them; a script without statements has one row of its own."""
    level = lambda rows: written(_facts_of(_told(_pieces(rows)).withColumn("beyond", F.lit(False))), "facts")
    now = level(_top(scripts))
    out = now
    for _ in range(DEPTH):
        if now.where("body IS NOT NULL").isEmpty():
            break
        now = level(_inner(now))
        out = out.unionByName(now)
    none, bare = F.lit(None).cast("string"), {"text": F.lit(""), "flat": F.lit("")}
    context = F.when(F.col("kind") == "DoBlock", "do-block").otherwise("function-body")
    deeper = now.where(F.col("body").isNotNull() & (F.col("depth") >= DEPTH)).drop("fact")
    deeper = deeper.withColumns({"position": F.concat("position", F.array(F.lit(0))), "context": context, **bare, "body": none, "beyond": F.lit(True)}).withColumn("kind", F.lit("Unrecognized"))
    empty = scripts.where(F.col("clean").rlike("^[; ]*$")).select("file", F.array(F.lit(0)).alias("position"), F.array(F.lit(0)).alias("at"), F.lit("EmptyInput").alias("kind"))
    empty = empty.withColumns({**bare, "language": none, "body": none, "context": F.lit("top-level"), "depth": F.lit(0), "beyond": F.lit(False)})
    for more in (deeper, empty):
        out = out.unionByName(_facts_of(more))
    return out.select("file", "position", "at", "kind", "fact")


def findings(scripts: DataFrame, rules: DataFrame) -> DataFrame:
    """file, position, verdict, rule_ids, paired_with, rationales, at, fact of every statement; an empty script has one finding of its own.

    paired_with is the partner's number in its script. The facts are read several times, so they are written to the shared folder
    once. Scripts are taken as they are: parse faults (see ``parse_faults``) are their caller's to leave out. Those of ``read``
    bring their ``clean`` text along.
    """
    told = _examined((scripts if "clean" in scripts.columns else read(scripts)).select("file", "clean"))
    floor = F.col("kind").isin(*FLOOR) | (F.col("kind").isin("Delete", "Update") & ~F.col("fact.hasWhereClause"))
    plain = classify(typed_facts(told.withColumn("floor", floor)), rules, ["file", "position", "at", "fact", "floor"])
    met = pairs(told).join(F.broadcast(rules.select("rule_id", "rationale")), "rule_id", "left")
    return apply_pairings(plain, met)


def parse_faults(scripts: DataFrame) -> DataFrame:
    """file, at_character (from 1), reason of scripts that cannot be SQL, the first fault of each."""
    return judged(scripts).where("fault IS NOT NULL").select("file", "fault.*")


def analysis(scripts: DataFrame, rules: DataFrame) -> DataFrame:
    """file, verdict, statement_count, parse_error, findings: everything that is known of each script, in order.

    A finding has statementIndex, nestedPath (empty for a statement that stands alone, else its number, those in the bodies that
    hold it, and that of the action or object), verdict, ruleIds and rationales in step, facts and pairedWith.
    A script with a parse fault has no verdict and no findings, only parse_error.
    """
    told = read(scripts)
    found = findings(told.where("fault IS NULL"), rules)
    one = F.struct(
        F.col("at")[0].alias("statementIndex"),
        F.when(F.size("at") > 1, F.col("at")).otherwise(F.array().cast("array<int>")).alias("nestedPath"),
        "verdict",
        F.col("rule_ids").alias("ruleIds"),
        "rationales",
        F.col("fact").alias("facts"),
        F.col("paired_with").alias("pairedWith"),
    )
    per_file = found.groupBy("file").agg(
        F.max_by("verdict", severity(F.col("verdict"))).alias("verdict"),
        F.count_distinct(F.when(F.col("fact.statementKind") != "EmptyInput", F.col("at")[0])).alias("statement_count"),
        F.array_sort(F.collect_list(F.struct("position", one.alias("one"))))["one"].alias("findings"),
    )
    faulty = told.where("fault IS NOT NULL").select("file", F.concat("fault.reason", F.lit(" (at character "), F.col("fault.at_character").cast("string"), F.lit(")")).alias("parse_error"))
    return per_file.withColumn("parse_error", F.lit(None).cast("string")).unionByName(faulty, allowMissingColumns=True).select("file", "verdict", "statement_count", "parse_error", "findings")


def verdicts(scripts: DataFrame, rules: DataFrame) -> DataFrame:
    """file, verdict, rule_ids (distinct, sorted, joined by commas): the worst finding of each script, or PARSE_ERROR."""
    told = read(scripts)
    found = findings(told.where("fault IS NULL"), rules)
    ids = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rule_ids")))), ",")
    worst = found.groupBy("file").agg(F.max_by("verdict", severity(F.col("verdict"))).alias("verdict"), ids.alias("rule_ids"))
    return worst.unionByName(told.where("fault IS NOT NULL").select("file", F.lit("PARSE_ERROR").alias("verdict"), F.lit("").alias("rule_ids")))


def nested(levels: int) -> str:
    """DO blocks in one another."""
    text = "NULL"
    for k in range(levels):
        text = f"DO $l{k}$ BEGIN {text}; END $l{k}$"
    return text + ";"


#: Our own scripts of the shapes that matter, and what each must give.
_GOLDEN: list[tuple[str, str, str, str]] = [
    ("multi-drop", "DROP TABLE a, b;", "BLOCKED", "drop-table"),
    ("alter-both", "ALTER TABLE t ADD COLUMN x int, DROP COLUMN y;", "BLOCKED", "add-column-nullable-no-default,drop-column"),
    ("do-drop", "DO $$ BEGIN DROP TABLE t; END $$;", "BLOCKED", "do-block-container,drop-table"),
    ("comment-only", "-- DROP TABLE t\n", "REVIEW_REQUIRED", "empty-input"),
    ("inert-text", "COMMENT ON TABLE t IS 'DROP TABLE t';", "SAFE", "comment-on"),
    ("gap", "DROP /* x */ TABLE \"Odd\";", "BLOCKED", "drop-table"),
    ("delete-all", "DELETE FROM t;", "BLOCKED", "delete-without-where"),
    ("delete-some", "DELETE FROM t WHERE id = 1;", "REVIEW_REQUIRED", ""),
    ("volatile", "ALTER TABLE t ADD COLUMN x uuid DEFAULT gen_random_uuid();", "REVIEW_REQUIRED", "add-column-volatile-default"),
    ("stable", "ALTER TABLE t ADD COLUMN x timestamptz DEFAULT now();", "SAFE", "add-column-nonvolatile-default"),
    ("unknown-default", "ALTER TABLE t ADD COLUMN x int DEFAULT my_fn();", "REVIEW_REQUIRED", ""),
    ("concurrent", "CREATE INDEX CONCURRENTLY i ON t (a);", "SAFE", "create-index-concurrently"),
    ("plain-index", "CREATE INDEX i ON t (a);", "REVIEW_REQUIRED", "create-index-not-concurrently"),
    ("disarm", "SET lock_timeout = 0; CREATE TABLE t (a int);", "BLOCKED", "create-table,disarms-timeout-guc"),
    ("other-guc", "SET search_path = a;", "REVIEW_REQUIRED", "set-guc-non-timeout"),
    ("fk-not-valid", "ALTER TABLE t ADD CONSTRAINT c FOREIGN KEY (a) REFERENCES b (id) NOT VALID;", "SAFE", "add-foreign-key-not-valid"),
    ("fk", "ALTER TABLE t ADD CONSTRAINT c FOREIGN KEY (a) REFERENCES b (id);", "REVIEW_REQUIRED", "add-foreign-key-validated"),
    ("dynamic", "DO $x$ BEGIN EXECUTE 'DROP ' || 'TABLE t'; END $x$;", "BLOCKED", "do-block-container,unresolvable-dynamic-sql"),
    ("insert", "INSERT INTO t VALUES (1);", "REVIEW_REQUIRED", ""),
    ("create", "CREATE TABLE t (a int, b text);", "SAFE", "create-table"),
    ("rename", "ALTER TABLE t RENAME COLUMN a TO b;", "REVIEW_REQUIRED", "rename-column"),
    ("set-not-null", "ALTER TABLE t ALTER COLUMN a SET NOT NULL;", "REVIEW_REQUIRED", "set-not-null"),
    ("vacuum", "VACUUM t;", "REVIEW_REQUIRED", "vacuum-in-migration"),
    ("pair-fk", "ALTER TABLE s.t ADD CONSTRAINT c FOREIGN KEY (a) REFERENCES b (id) NOT VALID; ALTER TABLE t VALIDATE CONSTRAINT c;", "SAFE", "add-foreign-key-not-valid,pair-not-valid-validated,validate-constraint"),
    ("pair-index", "CREATE UNIQUE INDEX CONCURRENTLY i ON t (a); ALTER TABLE t ADD CONSTRAINT u UNIQUE USING INDEX i;", "SAFE", "create-index-concurrently,pair-concurrent-index-unique"),
    ("near-miss-index", "CREATE UNIQUE INDEX CONCURRENTLY i ON t (a); ALTER TABLE t ADD CONSTRAINT u UNIQUE USING INDEX other;", "REVIEW_REQUIRED", "create-index-concurrently"),
    (
        "pair-not-null",
        "ALTER TABLE t ADD CONSTRAINT c CHECK (a IS NOT NULL) NOT VALID; ALTER TABLE t VALIDATE CONSTRAINT c; ALTER TABLE t ALTER COLUMN a SET NOT NULL;",
        "SAFE",
        "add-check-constraint-not-valid,pair-not-valid-validated,pair-validated-check-set-not-null,set-not-null,validate-constraint",
    ),
    ("hidden-after-dashes", "COMMENT ON TABLE t IS '-- '; DROP TABLE x;", "BLOCKED", "comment-on,drop-table"),
    ("hidden-between-marks", "COMMENT ON TABLE t IS '/*'; DROP TABLE x; COMMENT ON TABLE t IS '*/';", "BLOCKED", "comment-on,drop-table"),
    ("hidden-by-name", 'COMMENT ON TABLE "a--b" IS NULL; DROP TABLE x;', "BLOCKED", "comment-on,drop-table"),
    ("hidden-between-dollars", "COMMENT ON TABLE t IS '$$'; DROP TABLE x; COMMENT ON TABLE t IS '$$';", "BLOCKED", "comment-on,drop-table"),
    ("hidden-by-escape", "COMMENT ON TABLE t IS E'it\\'; DROP TABLE x; COMMENT ON TABLE t IS '\\''; DROP TABLE y;", "BLOCKED", "comment-on,drop-table"),
    ("escape-inert", "COMMENT ON TABLE t IS E'it\\'; DROP TABLE x; --';", "SAFE", "comment-on"),
    ("nested-comment", "/* a /* b */ DROP TABLE x; */ CREATE TABLE t (a int);", "SAFE", "create-table"),
    ("open-quote", "CREATE TABLE t (a text DEFAULT 'x);", "PARSE_ERROR", ""),
    ("open-dollars", "DO $a$ BEGIN NULL; END $b$;", "PARSE_ERROR", ""),
    ("open-parentheses", "CREATE TABLE (((;", "PARSE_ERROR", ""),
    ("no-command", "CREATE TABLE t (a int); SELEC 1;", "PARSE_ERROR", ""),
    ("enum-value", "ALTER TYPE mood DROP VALUE 'sad';", "PARSE_ERROR", ""),
    ("dollar-inert", "INSERT INTO t VALUES ($a$DROP TABLE t$a$);", "REVIEW_REQUIRED", ""),
    ("where-in-subquery", "UPDATE t SET a = (SELECT b FROM u WHERE u.id = 1);", "BLOCKED", "update-without-where"),
    ("where-as-name", 'UPDATE t SET "where" = 1;', "BLOCKED", "update-without-where"),
    ("default-expression", "ALTER TABLE t ADD COLUMN x timestamptz DEFAULT now() + random() * interval '1 day';", "REVIEW_REQUIRED", ""),
    ("default-cast", "ALTER TABLE t ADD COLUMN x timestamp DEFAULT pg_catalog.now()::timestamp NOT NULL;", "SAFE", "add-column-nonvolatile-default"),
    ("statement-time", "ALTER TABLE t ADD COLUMN x timestamptz DEFAULT statement_timestamp();", "REVIEW_REQUIRED", "add-column-volatile-default"),
    ("body-as-text", "CREATE FUNCTION f() RETURNS void AS 'DROP TABLE t' LANGUAGE sql;", "BLOCKED", "create-function-container,drop-table"),
    ("body-atomic", "CREATE FUNCTION f() RETURNS void LANGUAGE sql BEGIN ATOMIC UPDATE t SET a = CASE WHEN b THEN 1 END WHERE c; DELETE FROM t; END; CREATE TABLE u (a int);", "BLOCKED", "create-function-container,create-table,delete-without-where"),
    ("body-other-language", "DO LANGUAGE plpython3u $$ import os $$;", "REVIEW_REQUIRED", "container-body-not-inspected"),
    ("body-inert", "DO $$ BEGIN RAISE NOTICE 'DROP TABLE t'; END; $$;", "SAFE", "do-block-container"),
    ("body-inert-dollars", "DO $$ BEGIN /* SET lock_timeout = 0; */ RAISE NOTICE $m$SET lock_timeout = 0;$m$; END $$; ALTER TABLE t ADD COLUMN n text;", "SAFE", "add-column-nullable-no-default,do-block-container"),
    ("body-lock", "DO $$ BEGIN LOCK TABLE t; CALL p(); END $$;", "REVIEW_REQUIRED", "do-block-container"),
    ("body-select", "CREATE FUNCTION f() RETURNS int AS $$ SELECT 1 $$ LANGUAGE sql;", "REVIEW_REQUIRED", "create-function-container"),
    ("body-in-body", "DO $a$ BEGIN CREATE FUNCTION f() RETURNS void AS $b$ BEGIN DROP TABLE t; END $b$ LANGUAGE plpgsql; END $a$;", "BLOCKED", "create-function-container,do-block-container,drop-table"),
    ("bodies-in-bodies", nested(3), "SAFE", "do-block-container"),
    ("case-in-body", "DO $$ BEGIN UPDATE t SET a = CASE WHEN b THEN 1 ELSE 2 END WHERE c = 1; END $$;", "REVIEW_REQUIRED", "do-block-container"),
    ("action-unknown", "ALTER TABLE t ADD COLUMN x numeric(10,2) DEFAULT 0, ENABLE ROW LEVEL SECURITY;", "REVIEW_REQUIRED", "add-column-nonvolatile-default"),
    ("create-as", "CREATE TABLE t AS SELECT 1;", "REVIEW_REQUIRED", ""),
    ("unnamed-constraint", "ALTER TABLE t ADD UNIQUE (a);", "REVIEW_REQUIRED", "add-unique-constraint"),
    ("names-differ-in-case", 'ALTER TABLE "T" ADD CONSTRAINT c FOREIGN KEY (a) REFERENCES b (id) NOT VALID; ALTER TABLE t VALIDATE CONSTRAINT c;', "SAFE", "add-foreign-key-not-valid,validate-constraint"),
    ("reset-all", "RESET ALL;", "BLOCKED", "disarms-timeout-guc"),
    ("set-before-check", "ALTER TABLE t ALTER COLUMN a SET NOT NULL; ALTER TABLE t ADD CONSTRAINT c CHECK (a IS NOT NULL) NOT VALID;", "REVIEW_REQUIRED", "add-check-constraint-not-valid,set-not-null"),
]
EXAMPLES = [(file, sql) for file, sql, _, _ in _GOLDEN]
#: number, file, verdict, rule_ids of the examples, as SQL values.
GOLDEN_SQL = "(VALUES " + ", ".join(f"({k}, '{f}', '{v}', '{r}')" for k, (f, _, v, r) in enumerate(_GOLDEN)) + ") g(k, shape, verdict, rule_ids)"
