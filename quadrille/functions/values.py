"""Values of expressions as Spark columns.

A value is held in the narrowest form known when the plan is built: a native column
for a mapped relational column or a computed result, a term string otherwise.  An error
is NULL, which makes AND, OR, NOT and IN of SQL those of SPARQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.terms import INTEGERS, RDF, XSD, parse_literal
from quadrille.terms import kind as term_kind

DECIMAL = "decimal(38,18)"
_NUMERIC = [f"{XSD}{n}" for n in (*INTEGERS, "decimal", "float", "double")]


@dataclass(frozen=True)
class Rep:
    """How a column holds terms: ``term`` strings, a native type, or an IRI of a fixed prefix by its key.

    ``iri`` with prefix p holds the key k of ``<p k>``.
    """

    kind: str
    prefix: str = ""


TERM = Rep("term")
INTEGER, DEC, DOUBLE, BOOLEAN, STRING, DATETIME = (Rep(k) for k in ("integer", "decimal", "double", "boolean", "string", "dateTime"))
NUMBERS = ("integer", "decimal", "double")


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def quoted(lex: Column) -> Column:
    """The literal's lexical form between quotes, escaped."""
    out = F.replace(lex, F.lit("\\"), F.lit("\\\\"))
    for char, mark in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(char), F.lit(mark))
    return F.concat(F.lit('"'), out, F.lit('"'))


def typed_literal(lex: Column, datatype: str) -> Column:
    return F.concat(F.lit('"'), lex, F.lit(f'"^^<{datatype}>'))


def double_text(x: Column) -> Column:
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "INF").when(x == float("-inf"), "-INF").otherwise(x.cast("string"))


def decimal_text(x: Column) -> Column:
    """Without trailing zeros, but with one digit after the point."""
    plain = F.regexp_replace(x.cast(DECIMAL).cast("string"), r"0+$", "")
    return F.when(x == 0, "0.0").when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)


def datetime_text(x: Column) -> Column:
    text = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(text, r"\.0+$|(?<=\.\d{1,5})0+$", "")


def to_term(col: Column, rep: Rep) -> Column:
    """The term strings of a column."""
    if rep.kind == "term":
        return col
    if rep.kind == "iri":
        return F.concat(F.lit(f"<{rep.prefix}"), col.cast("string"), F.lit(">"))
    if rep.kind == "string":
        return quoted(col)
    text = {"integer": lambda: col.cast("string"), "decimal": lambda: decimal_text(col), "double": lambda: double_text(col), "boolean": lambda: col.cast("string"), "dateTime": lambda: datetime_text(col)}[rep.kind]()
    return typed_literal(text, XSD + rep.kind)


# --- lanes of term strings ------------------------------------------------------------


def kind_of(t: Column) -> Column:
    """i, b, l or t."""
    return F.when(t.startswith('"'), "l").when(t.startswith("<<("), "t").when(t.startswith("<"), "i").when(t.startswith("_"), "b")


def _suffix(t: Column) -> Column:
    """What follows a literal's closing quote; NULL for other terms."""
    return F.when(t.startswith('"'), F.regexp_extract(t, r'"(|@[A-Za-z0-9-]+|\^\^<[^>]*>)$', 1))


def _raw_lex(t: Column, suffix: Column) -> Column:
    return t.substr(F.lit(2), F.length(t) - F.length(suffix) - 2)


def lex_of(t: Column, suffix: Column | None = None) -> Column:
    """Lexical form of a literal; NULL for other terms."""
    end = _suffix(t) if suffix is None else suffix
    raw = _raw_lex(t, end)
    out = F.replace(raw, F.lit("\\\\"), F.lit("\x01"))
    for mark, char in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r")):
        out = F.replace(out, F.lit(mark), F.lit(char))
    return F.when(F.contains(raw, F.lit("\\")), F.replace(out, F.lit("\x01"), F.lit("\\"))).otherwise(raw)


def with_lanes(df: DataFrame, column: str) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with a term column's parts as columns of their own, so that they are taken apart once."""
    t = F.col(column)
    names = {n: f"{column}__{n}" for n in ("suffix", "lex", "datatype", "number")}
    if names["suffix"] not in df.columns:
        df = df.withColumn(names["suffix"], _suffix(t))
        df = df.withColumn(names["lex"], lex_of(t, F.col(names["suffix"]))).withColumn(names["datatype"], _datatype(F.col(names["suffix"])))
        n = parse_number(_raw_lex(t, F.col(names["suffix"])), F.col(names["suffix"]))
        df = df.withColumn(names["number"], F.struct(n.rank.alias("rank"), n.exact.alias("exact"), n.approx.alias("approx")))
    return df, {n: F.col(c) for n, c in names.items()}


def lang_of(t: Column) -> Column:
    return F.when(t.startswith('"'), F.regexp_extract(_suffix(t), r"^@([A-Za-z0-9-]+?)(?:--(?:ltr|rtl))?$", 1))


def direction_of(t: Column) -> Column:
    return F.when(t.startswith('"'), F.regexp_extract(_suffix(t), r"^@[A-Za-z0-9-]+?--(ltr|rtl)$", 1))


def _datatype(suffix: Column) -> Column:
    kind = F.when(suffix == "", f"{XSD}string").when(suffix.startswith("^^<"), suffix.substr(F.lit(4), F.length(suffix) - 4))
    return kind.when(suffix.rlike("--(ltr|rtl)$"), f"{RDF}dirLangString").when(suffix.startswith("@"), f"{RDF}langString")


def datatype_of(t: Column) -> Column:
    return _datatype(_suffix(t))


_INTEGER_FORM, _DECIMAL_FORM = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
_DOUBLE_FORM = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATETIME_FORM = r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
DATE_FORM = r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?$"


def parse_double(lex: Column) -> Column:
    return F.when(lex == "NaN", float("nan")).when(lex.isin("INF", "+INF"), float("inf")).when(lex == "-INF", float("-inf")).when(lex.rlike(_DOUBLE_FORM), lex.try_cast("double"))


def instant(lex: Column) -> Column:
    """Microseconds of a dateTime, zone UTC where it has none."""
    return F.when(lex.rlike(DATETIME_FORM), F.unix_micros(F.when(lex.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$"), lex.try_cast("timestamp")).otherwise(F.concat(lex, F.lit("Z")).try_cast("timestamp"))))


@dataclass(frozen=True)
class Number:
    """rank 1 integer, 2 decimal, 3 float, 4 double; ``exact`` for ranks 1 and 2, ``approx`` for all."""

    rank: Column | int
    exact: Column | None
    approx: Column


#: By the suffix of an integer literal its smallest and largest value.
_LOW = {f"^^<{XSD}{n}>": low for n, (low, _) in INTEGERS.items()}
_HIGH = {f"^^<{XSD}{n}>": high for n, (_, high) in INTEGERS.items()}


def _looked_up(table: dict[str, int], suffix: Column) -> Column:
    pairs = [F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), suffix)


def parse_number(lex: Column, suffix: Column) -> Number:
    """The lanes of a literal, NULL where it is no number or ill-formed.  A number's form holds no escapes."""
    single, double, decimal = (suffix == f"^^<{XSD}{n}>" for n in ("float", "double", "decimal"))
    whole = F.when(lex.rlike(_INTEGER_FORM), lex.try_cast("bigint"))
    exact = F.when(decimal, F.when(lex.rlike(_DECIMAL_FORM), lex.try_cast(DECIMAL))).when(whole.between(_looked_up(_LOW, suffix), _looked_up(_HIGH, suffix)), whole.cast(DECIMAL))
    approx = F.when(double, parse_double(lex)).when(single, parse_double(lex).cast("float").cast("double")).otherwise(exact.cast("double"))
    rank = F.when(approx.isNotNull(), F.when(double, 4).when(single, 3).when(decimal, 2).otherwise(1))
    return Number(rank, exact, approx)


class Value:
    """A column in some representation, with the lanes that operators ask for."""

    def __init__(self, col: Column, rep: Rep, number: Number | None = None, lanes: dict[str, Column] | None = None):
        self.col, self.rep, self._number, self.lanes = col, rep, number, lanes

    @property
    def suffix(self) -> Column:
        """What follows a literal's closing quote; of a term."""
        return self.lanes["suffix"] if self.lanes else _suffix(self.term)

    @property
    def lex(self) -> Column:
        """A literal's lexical form; NULL for other terms."""
        return self.lanes["lex"] if self.lanes else lex_of(self.term)

    @property
    def datatype(self) -> Column:
        return self.lanes["datatype"] if self.lanes else datatype_of(self.term)

    @property
    def kind(self) -> str:
        return self.rep.kind

    @property
    def term(self) -> Column:
        if self.kind == "number":
            n = self._number
            return F.when(n.rank == 1, to_term(n.exact.cast("bigint"), INTEGER)).when(n.rank == 2, to_term(n.exact, DEC)).when(n.rank == 3, typed_literal(double_text(n.approx.cast("float")), f"{XSD}float")).when(n.rank == 4, to_term(n.approx, DOUBLE))
        return to_term(self.col, self.rep)

    @property
    def number(self) -> Number | None:
        """None if the value is known not to be a number."""
        if self._number is not None:
            return self._number
        if self.kind == "integer":
            return Number(1, self.col, self.col.cast("double"))
        if self.kind == "decimal":
            return Number(2, self.col, self.col.cast("double"))
        if self.kind == "double":
            return Number(4, None, self.col)
        if self.kind != "term":
            return None
        if self.lanes and "number" in self.lanes:
            n = self.lanes["number"]
            return Number(n.getField("rank"), n.getField("exact"), n.getField("approx"))
        return parse_number(_raw_lex(self.col, self.suffix), self.suffix)

    @property
    def string(self) -> Column:
        """Lexical form of a simple literal (xsd:string); NULL otherwise."""
        if self.kind == "string":
            return self.col
        if self.kind == "term":
            return F.when(self.suffix == "", self.lex)
        return null()

    @property
    def text(self) -> Column:
        """Lexical form of any string literal, tagged ones too; NULL otherwise."""
        if self.kind == "term":
            return F.when(~self.suffix.startswith("^^"), self.lex)
        return self.string

    @property
    def boolean(self) -> Column:
        """The value of an xsd:boolean; NULL otherwise."""
        if self.kind == "boolean":
            return self.col
        if self.kind != "term":
            return null("boolean")
        lex = self.lex
        return F.when(self.suffix == f"^^<{XSD}boolean>", F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False))

    @property
    def instant(self) -> Column:
        """Microseconds of a dateTime or dateTimeStamp; NULL otherwise."""
        if self.kind == "dateTime":
            return F.unix_micros(F.concat(self.col.cast("string"), F.lit("Z")).cast("timestamp"))
        if self.kind != "term":
            return null("bigint")
        return F.when(self.suffix.isin(f"^^<{XSD}dateTime>", f"^^<{XSD}dateTimeStamp>"), instant(self.lex))

    def effective(self) -> Column:
        """The effective boolean value."""
        if self.kind == "boolean":
            return self.col
        if self.kind == "string":
            return self.col != ""
        if self.kind in NUMBERS or self.kind == "number":
            x = self.number.approx
            return (x != 0) & ~F.isnan(x)
        if self.kind != "term":
            return null("boolean")
        n = self.number
        return F.when(n.rank.isNotNull(), (n.approx != 0) & ~F.isnan(n.approx)).otherwise(F.coalesce(self.boolean, F.when(self.suffix == "", self.lex != "")))


def constant(term: str) -> Value:
    """The value of a constant term, native where its form is canonical."""
    if term_kind(term) == "literal":
        lit = parse_literal(term)
        name = lit.datatype.removeprefix(XSD)
        if lit.datatype == f"{XSD}string":
            return Value(F.lit(lit.lex), STRING)
        if name == "integer" and lit.lex.lstrip("-").isdigit() and str(int(lit.lex)) == lit.lex and abs(int(lit.lex)) < 1 << 63:
            return Value(F.lit(int(lit.lex)).cast("bigint"), INTEGER)
        if name == "boolean" and lit.lex in ("true", "false"):
            return Value(F.lit(lit.lex == "true"), BOOLEAN)
    return Value(F.lit(term), TERM)


def numeric_constant(term: str) -> Value | None:
    """A number for comparisons, whose lexical form does not matter."""
    lit = parse_literal(term) if term_kind(term) == "literal" else None
    if not lit or lit.datatype not in _NUMERIC:
        return None
    try:
        if lit.datatype in (f"{XSD}double", f"{XSD}float"):
            return Value(F.lit(float(lit.lex.replace("INF", "inf"))), DOUBLE)
        if lit.datatype == f"{XSD}decimal":
            return Value(F.lit(lit.lex).cast(DECIMAL), DEC)
        return Value(F.lit(int(lit.lex)).cast("bigint"), INTEGER)
    except ValueError:
        return None


# --- relations ------------------------------------------------------------------------


def _float_compare(op: str, a: Column, b: Column) -> Column:
    """IEEE comparison: whatever meets NaN is false, or true for !=."""
    plain = {"=": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return plain & ~F.isnan(a) & ~F.isnan(b)


def _plain(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def _number_compare(op: str, a: Number, b: Number) -> Column:
    if isinstance(a.rank, int) and isinstance(b.rank, int):
        if max(a.rank, b.rank) >= 3:
            return _float_compare(op, a.approx, b.approx)
        return _plain(op, a.exact, b.exact)
    rank_a, rank_b = (F.lit(x.rank) if isinstance(x.rank, int) else x.rank for x in (a, b))
    exact = _plain(op, a.exact.cast(DECIMAL), b.exact.cast(DECIMAL)) if a.exact is not None and b.exact is not None else null("boolean")
    return F.when((rank_a >= 3) | (rank_b >= 3), _float_compare(op, a.approx, b.approx)).when(rank_a.isNotNull() & rank_b.isNotNull(), exact)


def compare(op: str, a: Value, b: Value) -> Column:
    """``= != < > <= >=`` of two values; NULL is an error."""
    if op == "!=":
        return ~compare("=", a, b)
    one, two = a.number, b.number
    if one is not None and two is not None and "term" not in (a.kind, b.kind):
        return _number_compare(op, one, two)
    if a.kind == b.kind and a.kind in ("string", "boolean", "dateTime"):
        return _plain(op, a.col, b.col)
    if op == "=" and a.kind == b.kind == "iri" and a.rep.prefix == b.rep.prefix:
        return a.col == b.col
    dynamic = "term" in (a.kind, b.kind)
    if not dynamic:
        return F.lit(False) & a.col.isNotNull() & b.col.isNotNull() if op == "=" else null("boolean")
    if "term" not in (a.kind, b.kind) or a.kind != b.kind:
        fixed, other = (b, a) if a.kind == "term" else (a, b)
        return _fixed_compare(op if fixed is b else {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), other, fixed)
    out = F.when(a.term.isNull() | b.term.isNull(), null("boolean"))
    if one is not None and two is not None:
        numeric = _number_compare(op, one, two)
        ranked = [x for x in (one.rank, two.rank) if not isinstance(x, int)]
        both = ranked[0].isNotNull() if len(ranked) == 1 else ranked[0].isNotNull() & ranked[1].isNotNull()
        out = out.when(both, numeric)
    known = []
    for lane in ("string", "boolean", "instant"):
        x, y = getattr(a, lane), getattr(b, lane)
        known.append((x, y))
        out = out.when(x.isNotNull() & y.isNotNull(), _plain(op, x, y))
    dates = [F.when(v.suffix == f"^^<{XSD}date>", v.lex) if v.kind == "term" else null() for v in (a, b)]
    out = out.when(dates[0].isNotNull() & dates[1].isNotNull(), _dates(op, *dates))
    if op != "=":
        return out.otherwise(null("boolean"))
    same = a.term == b.term
    known_a = F.coalesce(*[x.isNotNull() for x, _ in known[:1]]) | known[1][0].isNotNull() | known[2][0].isNotNull() | dates[0].isNotNull()
    known_b = known[0][1].isNotNull() | known[1][1].isNotNull() | known[2][1].isNotNull() | dates[1].isNotNull()
    if one is not None:
        known_a = known_a | (F.lit(True) if isinstance(one.rank, int) else one.rank.isNotNull())
    if two is not None:
        known_b = known_b | (F.lit(True) if isinstance(two.rank, int) else two.rank.isNotNull())
    tagged = lambda v: F.coalesce(v.suffix.startswith("@"), F.lit(False))
    literals = a.term.startswith('"') & b.term.startswith('"')
    unclear = literals & ~((known_a | tagged(a)) & (known_b | tagged(b))) & ~(tagged(a) | tagged(b))
    return out.when(same, True).when(unclear, null("boolean")).otherwise(False)


def _fixed_compare(op: str, v: Value, fixed: Value) -> Column:
    """A term against a value whose type is known, which leaves one family to look at."""
    if fixed.number is not None:
        n = v.number
        found, same = _number_compare(op, n, fixed.number), n.rank.isNotNull()
    elif fixed.kind == "string":
        found, same = _plain(op, v.lex, fixed.col), v.suffix == ""
    elif fixed.kind == "boolean":
        found, same = _plain(op, v.boolean, fixed.col), v.boolean.isNotNull()
    elif fixed.kind == "dateTime":
        found, same = _plain(op, v.instant, fixed.instant), v.instant.isNotNull()
    else:
        return v.term == fixed.term if op == "=" else null("boolean")
    if op != "=":
        return F.when(same, found)
    others = [f"^^<{XSD}{n}>" for n in ("boolean", "dateTime", "dateTimeStamp", "date")]
    clear = F.coalesce((v.suffix == "") | v.suffix.startswith("@") | v.suffix.isin(others) | v.number.rank.isNotNull(), v.term.isNotNull()) if fixed.number is None else F.coalesce((v.suffix == "") | v.suffix.startswith("@") | v.suffix.isin(others), v.term.isNotNull())
    return F.when(same & fixed.term.isNotNull(), found).when(clear, False)


_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})$"


def _start(x: Column) -> Column:
    """Microseconds of a date's first moment, zone UTC where it has none."""
    day = F.regexp_replace(x, _ZONE, "")
    mark = F.regexp_extract(x, _ZONE, 1)
    return F.when(x.rlike(DATE_FORM), F.unix_micros(F.concat(day, F.lit("T00:00:00"), F.when(mark == "", "Z").otherwise(mark)).try_cast("timestamp")))


def _dates(op: str, a: Column, b: Column) -> Column:
    """Dates: those of which one has a zone compare only when more than 14 hours apart."""
    x, y = _start(a), _start(b)
    alike = a.rlike(_ZONE) == b.rlike(_ZONE)
    apart = F.abs(x - y) > 14 * 3600 * 1_000_000
    return F.when(alike | apart, _plain(op, x, y))


def plainly_equal(a: Value, b: Value) -> bool:
    """Whether ``compare`` tells their equality by that of two columns."""
    return "term" not in (a.kind, b.kind) and "number" not in (a.kind, b.kind)


def equality_key(v: Value) -> Column:
    """Text that values share wherever ``compare`` finds them equal; unequal values may share it too."""
    if v.number is not None and isinstance(v.number.rank, int):
        return _number_key(v.number.approx)
    if v.kind == "iri":
        return v.term
    if v.kind == "string":
        return F.concat(F.lit("s"), v.col)
    if v.kind == "number":
        return _number_key(v.number.approx)
    others = [F.concat(F.lit("b"), v.boolean.cast("string")), F.concat(F.lit("i"), v.instant.cast("string"))]
    if v.kind != "term":
        return F.coalesce(*others)
    date = F.when(v.suffix == f"^^<{XSD}date>", v.lex)
    return F.coalesce(_number_key(v.number.approx), F.concat(F.lit("s"), v.string), *others, F.concat(F.lit("d"), _start(date).cast("string")), v.term)


def _number_key(x: Column) -> Column:
    return F.concat(F.lit("n"), F.when(x == 0, 0.0).otherwise(x).cast("string"))


def same_term(a: Value, b: Value) -> Column:
    if a.rep == b.rep and a.kind not in ("number", "double", "decimal"):
        return a.col == b.col
    return a.term == b.term


# --- arithmetic -----------------------------------------------------------------------


def _in_range(x: Column) -> Column:
    return x.try_cast("bigint")


def _divide(a: Column, b: Column, whole: bool) -> Column:
    """Decimal division with 18 digits; NULL by zero.  Whole numbers of up to 20 digits, others below 10^11."""
    left, right = ("decimal(20,0)", "decimal(20,0)") if whole else ("decimal(29,18)", "decimal(29,9)")
    return F.try_divide(a.try_cast(left), b.try_cast(right)).try_cast(DECIMAL)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    one, two = a.number, b.number
    if one is None or two is None:
        return Value(null(), TERM)
    tries = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}
    floats = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}

    def by_float(x: Column, y: Column) -> Column:
        if op != "/":
            return floats[op](x, y)
        infinite = F.when(F.isnan(x) | (x == 0), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
        return F.when(y == 0, infinite).otherwise(F.try_divide(x, y))

    if isinstance(one.rank, int) and isinstance(two.rank, int):
        rank = max(one.rank, two.rank)
        if rank >= 3:
            return Value(by_float(one.approx, two.approx), DOUBLE)
        if op == "/":
            return Value(_divide(one.exact, two.exact, rank == 1), DEC)
        if rank == 1:
            return Value(tries[op](one.exact.cast("bigint"), two.exact.cast("bigint")), INTEGER)
        return Value(tries[op](one.exact.cast(DECIMAL), two.exact.cast(DECIMAL)).try_cast(DECIMAL), DEC)
    ranks = [F.lit(x.rank) if isinstance(x.rank, int) else x.rank for x in (one, two)]
    rank = F.when(ranks[0].isNotNull() & ranks[1].isNotNull(), F.greatest(*ranks))
    exacts = [x.exact.cast(DECIMAL) if x.exact is not None else null(DECIMAL) for x in (one, two)]
    if op == "/":
        exact = F.coalesce(_divide(*exacts, False), _divide(*exacts, True))
        rank = F.when(rank == 1, 2).otherwise(rank)
    else:
        exact = tries[op](*exacts).try_cast(DECIMAL)
        exact = F.when(rank == 1, F.when(exact.between(-(1 << 63), (1 << 63) - 1), exact)).otherwise(exact)
    approx = by_float(one.approx, two.approx)
    rank = F.when(rank >= 3, rank).when(exact.isNotNull(), rank)
    number = Number(rank, exact, F.when(rank >= 3, approx).otherwise(exact.cast("double")))
    return Value(null(), Rep("number"), number)


def unary(v: Value, on_whole, on_exact, on_float) -> Value:
    """A function of numbers that keeps their type."""
    n = v.number
    if n is None:
        return Value(null(), TERM)
    if v.kind == "integer":
        return Value(on_whole(v.col), INTEGER)
    if v.kind == "decimal":
        return Value(on_exact(v.col).cast(DECIMAL), DEC)
    if v.kind == "double":
        return Value(on_float(v.col), DOUBLE)
    exact = F.when(n.rank == 1, on_whole(n.exact.cast("bigint")).cast(DECIMAL)).when(n.rank == 2, on_exact(n.exact).cast(DECIMAL))
    return Value(null(), Rep("number"), Number(n.rank, exact, F.when(n.rank >= 3, on_float(n.approx)).otherwise(exact.cast("double"))))


def sort_key(v: Value) -> Column:
    """Ascending order of terms: unbound, blank, IRI, literal, triple; values within.

    Numbers come first among literals, by value, so that the order is total; other
    literals follow by family, then by value or lexical form, datatype and tag.
    """
    if v.kind in ("integer", "decimal", "double", "string", "boolean", "dateTime"):
        return v.col
    t = v.term
    n = v.number
    rank = F.when(t.startswith("_"), 1).when(t.startswith("<<("), 4).when(t.startswith("<"), 2).otherwise(3)
    number = F.when(n.rank.isNotNull(), n.approx) if n is not None and not isinstance(n.rank, int) else null("double")
    time = v.instant
    family = F.when(number.isNotNull(), 0).when(v.boolean.isNotNull(), 1).when(time.isNotNull(), 2).otherwise(3)
    lex = F.coalesce(v.lex, t)
    return F.when(t.isNotNull(), F.struct(rank.alias("r"), family.alias("f"), number.alias("n"), time.alias("t"), lex.alias("l"), t.alias("x")))

