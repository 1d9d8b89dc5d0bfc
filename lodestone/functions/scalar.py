"""Scalar functions as column expressions: the interpreter's builtins and the domain's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that begin an embedded SQL statement.
SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "EXECUTE", "DECLARE", "OPEN", "FETCH", "CLOSE", "COMMIT", "ROLLBACK", "CONNECT", "DISCONNECT")
# Control types by the prefix of the name; the first that fits counts, so longer prefixes stand first.
CONTROL_PREFIXES = (
    ("cbx_", "checkbox"), ("cb_", "commandbutton"), ("ddlb_", "dropdownlistbox"), ("ddplb_", "dropdownpicturelistbox"), ("dw_", "datawindow"), ("ds_", "datastore"), ("em_", "editmask"), ("gb_", "groupbox"), ("gr_", "graph"),
    ("hpb_", "hprogressbar"), ("hsb_", "hscrollbar"), ("lb_", "listbox"), ("ln_", "line"), ("lv_", "listview"), ("mle_", "multilineedit"), ("ole_", "olecontrol"), ("pb_", "picturebutton"), ("plb_", "picturelistbox"), ("rb_", "radiobutton"),
    ("rte_", "richtextedit"), ("r_", "rectangle"), ("sle_", "singlelineedit"), ("st_", "statictext"), ("tab_", "tab"), ("tabpage_", "userobject"), ("tv_", "treeview"), ("uo_", "userobject"), ("vpb_", "vprogressbar"), ("vsb_", "vscrollbar"),
    ("p_", "picture"), ("mdi_", "mdiclient"),
)
# Families of the primitive types.
FAMILIES = {
    "numeric": ("integer", "int", "long", "longlong", "longptr", "byte", "decimal", "dec", "double", "real", "number", "unsignedinteger", "unsignedint", "uint", "unsignedlong", "ulong"),
    "string": ("string", "char", "character"), "boolean": ("boolean",), "datetime": ("date", "time", "datetime"), "blob": ("blob",), "any": ("any",),
}


def mid(s: Column, start: Column, n: Column | None = None) -> Column:
    """The part of s from the 1-based start, n characters or to the end; start below 1 counts as 1."""
    begin = F.greatest(start, F.lit(1))
    return F.substring(s, begin, F.length(s) if n is None else n)


def left(s: Column, n: Column) -> Column:
    return F.left(s, n)


def right(s: Column, n: Column) -> Column:
    """The last n characters; for n = 0 the whole string, as in the reference."""
    return F.when(n == 0, s).otherwise(F.right(s, n))


def length(s: Column) -> Column:
    """UTF-16 units, of which a character beyond the basic plane has two."""
    return F.length(s) + F.length(F.regexp_replace(s, "[^\\x{10000}-\\x{10FFFF}]", ""))


def pos(s: Column, what: Column) -> Column:
    """The 1-based place of ``what`` in s, 0 if absent; case matters."""
    return F.call_function("locate", what, s)


def trim(s: Column) -> Column:
    """Without white space at either end, tabs and line ends included."""
    return F.regexp_replace(s, r"^[\s\x{FEFF}\x{A0}]+|[\s\x{FEFF}\x{A0}]+$", "")


def space(n: Column) -> Column:
    return F.repeat(F.lit(" "), n)


def fill(n: Column, what: Column) -> Column:
    return F.repeat(what, n)


def replace(s: Column, old: Column, new: Column) -> Column:
    """s with every ``old`` replaced."""
    return F.replace(s, old, new)


def integer(s: Column) -> Column:
    """The whole number that s begins with, else 0 (also ``long``)."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"^\s*([-+]?\d+)", 1), F.lit("")).try_cast("long"), F.lit(0).cast("long"))


def real(s: Column) -> Column:
    """The decimal number that s begins with, else 0 (also ``dec``)."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1), F.lit("")).try_cast("double"), F.lit(0.0))


def is_number(s: Column) -> Column:
    """Whether s is a number; the empty string counts as 0."""
    return (F.trim(s) == "") | s.try_cast("double").isNotNull()


def is_date(s: Column) -> Column:
    """A stub in the reference: never."""
    return F.lit(False)


is_time = is_date


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of the dividend."""
    return a % b


def greatest(a: Column, b: Column) -> Column:
    """The greater of two numbers, NULL counting as 0."""
    return F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))


def least(a: Column, b: Column) -> Column:
    """The lesser of two numbers, NULL counting as 0."""
    return F.least(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))


def round_half_up(x: Column, digits: Column) -> Column:
    """x rounded to so many digits, halves towards plus infinity."""
    scale = F.pow(F.lit(10.0), digits)
    return F.floor(x * scale + 0.5) / scale


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def translated(key: Column) -> Column:
    """A stub in the reference: the key in brackets."""
    return F.concat(F.lit("["), key, F.lit("]"))


def last_dot_segment(s: Column) -> Column:
    return F.lower(F.element_at(F.split(s, "[.]"), -1))


def split_reference(ref: Column) -> Column:
    """(table, column) of ``table.column``, split at the last dot; NULL if malformed."""
    parts = F.struct(F.regexp_extract(ref, r"^(.+)\.([^.]+)$", 1).alias("table"), F.regexp_extract(ref, r"^(.+)\.([^.]+)$", 2).alias("column"))
    return F.when(ref.rlike(r"^.+\.[^.]+$"), parts)


def column_key(namespace: Column, table: Column, column: Column) -> Column:
    return F.concat(F.lit("col:"), F.concat_ws(".", namespace, table, column))


def statement_key(file: Column, object_: Column, proc: Column, line: Column) -> Column:
    """The key of a statement, tabs and line ends being spaces."""
    clean = lambda c: F.translate(F.coalesce(c.cast("string"), F.lit("")), "\t\r\n", "   ")
    return F.concat_ws(":", F.lit("stmt:sql"), clean(file), clean(object_), clean(proc), clean(line))


def sql_operation(text: Column) -> Column:
    """The SQL word that a text begins with, else NULL; semicolons behind it are ignored."""
    word = F.upper(F.regexp_extract(F.trim(text), r"^(\S+?);*(\s|$)", 1))
    return F.when(word.isin(*SQL_WORDS), word)


def host_variables(sql: Column) -> Column:
    """The names behind colons, in order, repeated ones too."""
    return F.regexp_extract_all(sql, F.lit(r":([\p{L}_0-9]+)"), F.lit(1))


def into_variables(sql: Column) -> Column:
    """The host variables between INTO and FROM; none for an INSERT."""
    span = F.regexp_extract(sql, r"(?is)\bINTO\b(.*?)(?:\bFROM\b|$)", 1)
    return F.when(F.upper(F.ltrim(sql)).startswith("INSERT"), F.array().cast("array<string>")).otherwise(host_variables(span))


def lint_codes(sql: Column, whole_word: bool = False) -> Column:
    """The lint findings of a statement. WHERE is a plain substring test, as in the reference; whole_word asks for the word."""
    upper = F.upper(sql)
    where = upper.rlike(r"\bWHERE\b") if whole_word else F.contains(upper, F.lit("WHERE"))
    star = F.when(upper.rlike(r"^\s*SELECT\s+\*"), "select_star")
    bare = F.when(upper.rlike(r"^\s*(UPDATE|DELETE)\b") & ~where, "write_no_where")
    return F.array_compact(F.array(star, bare))


def control_type(name: Column) -> Column:
    """The control type that a name's prefix suggests, else NULL."""
    out = F.lit(None).cast("string")
    for prefix, kind in reversed(CONTROL_PREFIXES):
        out = F.when(F.lower(name).startswith(prefix), kind).otherwise(out)
    return out


def type_family(text: Column) -> Column:
    """The family of a type's text; a type of no family is the user's own. NULL stays NULL."""
    name = F.regexp_replace(F.lower(F.trim(text)), r"\s*\{.*\}$", "")
    out = F.concat(F.lit("user_type:"), name)
    for family, names in FAMILIES.items():
        out = F.when(name.isin(*names), family).otherwise(out)
    return F.when(text.isNotNull(), out)


def compatible(target: Column, source: Column) -> Column:
    """Whether a value of one family may be assigned to another: equal families, any on either side, or an untyped one."""
    return target.isNull() | source.isNull() | (target == source) | (target == "any") | (source == "any")


def category(file: Column) -> Column:
    """An object's category by its file's extension."""
    names = {"sru": "userobject", "srw": "window", "srm": "menu", "srf": "function", "srs": "structure", "sra": "application", "srd": "datawindow", "srp": "pipeline", "srj": "project", "srq": "query"}
    ext = F.lower(F.regexp_extract(file, r"\.(\w+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[ext], F.lit("userobject"))


# Languages by extension; all others are scripts.
LANGUAGES = {"srd": "datawindow", "srp": "pipeline", "srj": "project"}


def language(kind: Column, file: Column) -> Column:
    """An object's language: its kind, or where that is NULL by the extension of its file, in any case."""
    extension = F.lower(F.regexp_extract(file, r"\.(\w+)\s*$", 1))
    by_extension = F.lit("powerscript")
    for ext, name in LANGUAGES.items():
        by_extension = F.when(extension == ext, name).otherwise(by_extension)
    return F.coalesce(F.nullif(F.lower(F.trim(kind)), F.lit("")), by_extension)


def library(file: Column) -> Column:
    """The first segment of a path that is a library."""
    return F.get(F.filter(F.split(file, "/"), lambda x: F.lower(x).endswith(".pbl")), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def cyclomatic(n_edges: Column, n_blocks: Column) -> Column:
    """E - N + 2, or 1 without a block."""
    return F.when(n_blocks == 0, 1).otherwise(n_edges - n_blocks + 2)


def unescape(text: Column) -> Column:
    """A string literal's text: ``~"`` and ``~~`` are the character itself."""
    return F.regexp_replace(text, r"~(.)", "$1")
