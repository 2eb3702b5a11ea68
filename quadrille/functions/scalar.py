"""SPARQL's operators and built-in functions over ``Value`` columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions import values as V
from quadrille.functions.values import BOOLEAN, DEC, DOUBLE, INTEGER, STRING, TERM, Value, null
from quadrille.plans import algebra as A
from quadrille.terms import INTEGERS, RDF, XSD, parse_literal, triple_parts


@dataclass
class Context:
    """What expressions need beside their arguments."""

    base: str = ""
    now: datetime | None = None
    seed: int | None = None
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)

    def instant(self) -> datetime:
        if self.now is None:
            self.now = datetime.now(timezone.utc)
        return self.now


class Expressions:
    """Compiles expressions over the variables of one frame."""

    def __init__(self, scope: dict[str, Value], context: Context, row_id: Callable[[], Column] | None = None):
        self.scope, self.context, self.row_id = scope, context, row_id

    def value(self, e: A.Node) -> Value:
        if isinstance(e, A.Var):
            return self.scope.get(e.name) or Value(null(), TERM)
        if isinstance(e, A.Const):
            return V.constant(e.term)
        if isinstance(e, A.Call):
            return self._call(e)
        raise TypeError(f"cannot stand in an expression: {type(e).__name__}")

    def condition(self, e: A.Node) -> Column:
        return self.value(e).effective()

    # --- dispatch ---------------------------------------------------------------

    def _call(self, e: A.Call) -> Value:
        name = e.name
        if name in ("=", "!=", "<", ">", "<=", ">="):
            return Value(V.compare(name, *map(self._operand, e.args)), BOOLEAN)
        if name in ("+", "-", "*", "/"):
            return V.arithmetic(name, *map(self._operand, e.args))
        if name in ("||", "&&"):
            a, b = map(self.condition, e.args)
            return Value(a | b if name == "||" else a & b, BOOLEAN)
        if name == "!":
            return Value(~self.condition(e.args[0]), BOOLEAN)
        if name in ("unary+", "unary-"):
            v = self._operand(e.args[0])
            if name == "unary+":
                return v if v.number is not None else Value(null(), TERM)
            return V.unary(v, lambda x: F.try_subtract(F.lit(0).cast("bigint"), x), lambda x: -x, lambda x: -x)
        if name in ("IN", "NOT IN"):
            return Value(self._in(e.args, name == "NOT IN"), BOOLEAN)
        if name.startswith("<"):
            return self._by_iri(name, e.args)
        return getattr(self, f"_{name.lower()}")(*e.args)

    def _operand(self, e: A.Node) -> Value:
        """An argument whose value alone matters, so any form of a number will do."""
        if isinstance(e, A.Const):
            return V.numeric_constant(e.term) or V.constant(e.term)
        return self.value(e)

    def _in(self, args: tuple[A.Node, ...], negated: bool) -> Column:
        first = self._operand(args[0])
        found = F.lit(False)
        for other in args[1:]:
            found = found | V.compare("=", first, self._operand(other))
        if len(args) == 1:
            found = F.when(first.term.isNotNull(), False)
        return ~found if negated else found

    # --- functional forms -----------------------------------------------------------

    def _bound(self, e: A.Node) -> Value:
        v = self.scope.get(e.name) if isinstance(e, A.Var) else self.value(e)
        return Value(F.lit(False) if v is None else (v.col if v.kind != "number" else v.term).isNotNull(), BOOLEAN)

    def _same(self, options: list[Value]) -> tuple[list[Column], V.Rep]:
        """Columns of several values in one representation."""
        reps = {v.rep for v in options}
        if len(reps) == 1 and options[0].kind != "number":
            return [v.col for v in options], options[0].rep
        return [v.term for v in options], TERM

    def _if(self, c: A.Node, a: A.Node, b: A.Node) -> Value:
        test = self.condition(c)
        (x, y), rep = self._same([self.value(a), self.value(b)])
        return Value(F.when(test, x).when(~test, y), rep)

    def _coalesce(self, *args: A.Node) -> Value:
        columns, rep = self._same([self.value(a) for a in args])
        return Value(F.coalesce(*columns), rep)

    def _sameterm(self, a: A.Node, b: A.Node) -> Value:
        return Value(V.same_term(self.value(a), self.value(b)), BOOLEAN)

    # --- kinds of terms ---------------------------------------------------------------

    def _is(self, e: A.Node, prefix: str, natives: tuple[str, ...]) -> Value:
        v = self.value(e)
        if v.kind in ("term", "number"):
            t = v.term
            found = t.startswith(prefix)
            return Value(found & ~t.startswith("<<(") if prefix == "<" else found, BOOLEAN)
        return Value(F.when(v.col.isNotNull(), v.kind in natives), BOOLEAN)

    def _isiri(self, e: A.Node) -> Value:
        return self._is(e, "<", ("iri",))

    _isuri = _isiri

    def _isblank(self, e: A.Node) -> Value:
        return self._is(e, "_", ())

    def _isliteral(self, e: A.Node) -> Value:
        return self._is(e, '"', ("integer", "decimal", "double", "boolean", "string", "dateTime"))

    def _istriple(self, e: A.Node) -> Value:
        return self._is(e, "<<(", ())

    def _isnumeric(self, e: A.Node) -> Value:
        v = self.value(e)
        n = v.number
        if n is None or isinstance(n.rank, int):
            return Value(F.when(v.term.isNotNull(), n is not None), BOOLEAN)
        return Value(F.when(v.term.isNotNull(), n.rank.isNotNull()), BOOLEAN)

    # --- parts of terms ---------------------------------------------------------------

    def _str(self, e: A.Node) -> Value:
        v = self.value(e)
        if v.kind == "string":
            return v
        if v.kind == "iri":
            return Value(F.concat(F.lit(v.rep.prefix), v.col.cast("string")), STRING)
        t = v.term
        return Value(F.when(t.startswith('"'), v.lex).when(t.startswith("<") & ~t.startswith("<<("), t.substr(F.lit(2), F.length(t) - 2)), STRING)

    def _lang(self, e: A.Node) -> Value:
        return Value(V.lang_of(self.value(e).term), STRING)

    def _langdir(self, e: A.Node) -> Value:
        return Value(V.direction_of(self.value(e).term), STRING)

    def _haslang(self, e: A.Node) -> Value:
        t = self.value(e).term
        return Value(F.when(t.isNotNull(), F.coalesce(V.lang_of(t) != "", F.lit(False))), BOOLEAN)

    def _haslangdir(self, e: A.Node) -> Value:
        t = self.value(e).term
        return Value(F.when(t.isNotNull(), F.coalesce(V.direction_of(t) != "", F.lit(False))), BOOLEAN)

    def _datatype(self, e: A.Node) -> Value:
        v = self.value(e)
        if v.kind in ("integer", "decimal", "double", "boolean", "string", "dateTime"):
            return Value(F.when(v.col.isNotNull(), f"<{XSD}{v.kind}>"), TERM)
        return Value(F.concat(F.lit("<"), v.datatype, F.lit(">")), TERM)

    def _iri(self, e: A.Node) -> Value:
        v = self.value(e)
        if v.kind == "iri":
            return v
        base = self.context.base
        text, t = v.string, v.term
        valid = text.rlike(r'^[^<>"{}|^`\\\x00-\x20]*$')
        absolute = text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
        resolved = text
        if base:

            @F.pandas_udf("string")
            def resolve(s: pd.Series) -> pd.Series:
                return s.map(lambda x: None if x is None else urljoin(base, x))

            resolved = F.when(absolute, text).otherwise(resolve(text))
        made = F.when(valid & (F.lit(bool(base)) | absolute), F.concat(F.lit("<"), resolved, F.lit(">")))
        return Value(F.when(t.startswith("<") & ~t.startswith("<<("), t).otherwise(made), TERM)

    _uri = _iri

    def _row(self) -> Column:
        return self.row_id() if self.row_id else F.monotonically_increasing_id()

    def _bnode(self, e: A.Node | None = None) -> Value:
        """A fresh node, or one for each string and solution."""
        if e is None:
            return Value(F.concat(F.lit("_:u"), F.replace(F.uuid(), F.lit("-"), F.lit(""))), TERM)
        return Value(F.concat(F.lit("_:q"), self._row().cast("string"), F.lit("x"), F.hex(self.value(e).string)), TERM)

    def _strdt(self, e: A.Node, datatype: A.Node) -> Value:
        lex, dt = self.value(e).string, self.value(datatype).term
        name = dt.substr(F.lit(2), F.length(dt) - 2)
        out = F.when(name == f"{XSD}string", V.quoted(lex)).otherwise(F.concat(V.quoted(lex), F.lit("^^"), dt))
        return Value(F.when(dt.startswith("<") & ~name.isin(f"{RDF}langString", f"{RDF}dirLangString"), out), TERM)

    def _strlang(self, e: A.Node, tag: A.Node) -> Value:
        lang = self.value(tag).string
        return Value(F.when(lang.rlike(r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$"), F.concat(V.quoted(self.value(e).string), F.lit("@"), F.lower(lang))), TERM)

    def _strlangdir(self, e: A.Node, tag: A.Node, direction: A.Node) -> Value:
        d = self.value(direction).string
        return Value(F.when(d.isin("ltr", "rtl"), F.concat(self._strlang(e, tag).col, F.lit("--"), d)), TERM)

    def _triple(self, s: A.Node, p: A.Node, o: A.Node) -> Value:
        parts = [self.value(x).term for x in (s, p, o)]
        good = ~parts[0].startswith('"') & parts[1].startswith("<") & ~parts[1].startswith("<<(")
        return Value(F.when(good, F.concat(F.lit("<<( "), parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2], F.lit(" )>>"))), TERM)

    def _part(self, e: A.Node, at: int) -> Value:
        return Value(triple_part(self.value(e).term, at), TERM)

    def _subject(self, e: A.Node) -> Value:
        return self._part(e, 0)

    def _predicate(self, e: A.Node) -> Value:
        return self._part(e, 1)

    def _object(self, e: A.Node) -> Value:
        return self._part(e, 2)

    # --- strings ----------------------------------------------------------------------

    def _tagged(self, text: Column, like: Value) -> Value:
        """A string with the tag of another."""
        if like.kind == "string":
            return Value(text, STRING)
        return Value(F.when(text.isNotNull(), F.concat(V.quoted(text), like.suffix)), TERM)

    def _compatible(self, a: Value, b: Value) -> Column:
        """Whether b may be an argument beside a: simple, or with the same tag."""
        if b.kind == "string":
            return F.lit(True)
        suffix = b.suffix
        return (suffix == "") | (suffix == a.suffix)

    def _test(self, a: A.Node, b: A.Node, test) -> Value:
        x, y = self.value(a), self.value(b)
        return Value(F.when(self._compatible(x, y), test(x.text, y.text)), BOOLEAN)

    def _strlen(self, e: A.Node) -> Value:
        return Value(F.length(self.value(e).text).cast("bigint"), INTEGER)

    def _ucase(self, e: A.Node) -> Value:
        v = self.value(e)
        return self._tagged(F.upper(v.text), v)

    def _lcase(self, e: A.Node) -> Value:
        v = self.value(e)
        return self._tagged(F.lower(v.text), v)

    def _strstarts(self, a: A.Node, b: A.Node) -> Value:
        return self._test(a, b, lambda x, y: x.startswith(y))

    def _strends(self, a: A.Node, b: A.Node) -> Value:
        return self._test(a, b, lambda x, y: x.endswith(y))

    def _contains(self, a: A.Node, b: A.Node) -> Value:
        return self._test(a, b, lambda x, y: F.contains(x, y))

    def _around(self, a: A.Node, b: A.Node, before: bool) -> Value:
        x, y = self.value(a), self.value(b)
        text, needle = x.text, y.text
        at = F.call_function("locate", needle, text)
        found = text.substr(F.lit(1), at - 1) if before else text.substr(at + F.length(needle), F.length(text))
        if x.kind == "string":
            return Value(F.when(self._compatible(x, y), F.when(at > 0, found).otherwise("")), STRING)
        return Value(F.when(self._compatible(x, y) & text.isNotNull() & needle.isNotNull(), F.when(at > 0, self._tagged(found, x).term).otherwise('""')), TERM)

    def _strbefore(self, a: A.Node, b: A.Node) -> Value:
        return self._around(a, b, True)

    def _strafter(self, a: A.Node, b: A.Node) -> Value:
        return self._around(a, b, False)

    def _substr(self, e: A.Node, start: A.Node, length: A.Node | None = None) -> Value:
        """Positions from 1, rounded as fn:substring does; NaN gives the empty string."""
        v = self.value(e)
        text = v.text
        first = F.floor(self._number(start) + 0.5)
        low = F.greatest(first, F.lit(1))
        whole = F.length(text).cast("double")
        end = whole + 1
        if length is not None:
            n = self._number(length)
            end = F.least(end, F.floor(self._number(start) + 0.5) + F.floor(n + 0.5))
        size = F.when(end > low, end - low).otherwise(0)
        bad = F.isnan(self._number(start)) | (F.isnan(self._number(length)) if length is not None else F.lit(False))
        out = F.when(bad, "").otherwise(text.substr(F.least(low, whole + 1).cast("int"), F.least(size, whole).cast("int")))
        return self._tagged(F.when(text.isNotNull(), out), v)

    def _number(self, e: A.Node) -> Column:
        n = self._operand(e).number
        return null("double") if n is None else n.approx.cast("double")

    def _concat(self, *args: A.Node) -> Value:
        parts = [self.value(a) for a in args]
        if not parts:
            return Value(F.lit(""), STRING)
        text = F.concat(*[p.text for p in parts])
        if all(p.kind == "string" for p in parts):
            return Value(text, STRING)
        suffixes = [p.suffix for p in parts]
        same = F.lit(True)
        for s in suffixes[1:]:
            same = same & (s == suffixes[0])
        return Value(F.when(text.isNotNull(), F.concat(V.quoted(text), F.when(same, suffixes[0]).otherwise(""))), TERM)

    def _encode_for_uri(self, e: A.Node) -> Value:
        out = F.url_encode(self.value(e).text)
        for mark, char in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            out = F.replace(out, F.lit(mark), F.lit(char))
        return Value(out, STRING)

    def _langmatches(self, a: A.Node, b: A.Node) -> Value:
        tag, wanted = F.lower(self.value(a).string), F.lower(self.value(b).string)
        return Value(F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))), BOOLEAN)

    def _pattern(self, pattern: A.Node, flags: A.Node | None) -> tuple[str, str] | None:
        """A constant pattern in Java's syntax; None if it or its flags are not constant."""
        if not isinstance(pattern, A.Const) or flags is not None and not isinstance(flags, A.Const):
            return None
        lit, mark = parse_literal(pattern.term), parse_literal(flags.term) if flags is not None else None
        return java_regex(lit.lex if lit else "", mark.lex if mark else "") if lit else ("", "invalid")

    def _regex(self, e: A.Node, pattern: A.Node, flags: A.Node | None = None) -> Value:
        text = self.value(e).text
        found = self._pattern(pattern, flags)
        if found is not None:
            return Value(null("boolean") if found[1] == "invalid" else text.rlike(found[0]), BOOLEAN)
        flag = self.value(flags).string if flags is not None else F.lit("")

        @F.pandas_udf("boolean")
        def search(s: pd.Series, p: pd.Series, f: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None or z is None else python_search(x, y, z) for x, y, z in zip(s, p, f)], dtype=object)

        return Value(search(text, self.value(pattern).string, flag), BOOLEAN)

    def _replace(self, e: A.Node, pattern: A.Node, replacement: A.Node, flags: A.Node | None = None) -> Value:
        v = self.value(e)
        found = self._pattern(pattern, flags)
        if found is None or found[1] == "invalid" or _matches_empty(found[0]):
            return Value(null(), TERM)
        out = F.regexp_replace(v.text, F.lit(found[0]), self.value(replacement).string)
        return self._tagged(out, v)

    # --- numbers ----------------------------------------------------------------------

    def _abs(self, e: A.Node) -> Value:
        return V.unary(self._operand(e), F.abs, F.abs, F.abs)

    def _ceil(self, e: A.Node) -> Value:
        return V.unary(self._operand(e), lambda x: x, F.ceil, _whole_float(F.ceil))

    def _floor(self, e: A.Node) -> Value:
        return V.unary(self._operand(e), lambda x: x, F.floor, _whole_float(F.floor))

    def _round(self, e: A.Node) -> Value:
        return V.unary(self._operand(e), lambda x: x, lambda x: F.floor(x + F.lit("0.5").cast("decimal(2,1)")), _whole_float(lambda x: F.floor(x + 0.5)))

    def _rand(self) -> Value:
        return Value(F.rand(self.context.seed), DOUBLE)

    # --- dates ------------------------------------------------------------------------

    def _now(self) -> Value:
        text = self.context.instant().isoformat().replace("+00:00", "Z")
        return Value(F.lit(f'"{text}"^^<{XSD}dateTime>'), TERM)

    def _date_part(self, e: A.Node, at: int) -> Column:
        v = self.value(e)
        if v.kind == "dateTime":
            lex = V.datetime_text(v.col)
        elif v.kind == "term":
            lex = F.when(v.datatype.isin(f"{XSD}dateTime", f"{XSD}dateTimeStamp"), v.lex)
            lex = F.when(V.instant(lex).isNotNull(), lex)
        else:
            return null()
        return F.regexp_extract(lex, r"^(-?\d+)-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d(?:\.\d+)?)(Z|[+-]\d\d:\d\d)?$", at)

    def _year(self, e: A.Node) -> Value:
        return Value(self._date_part(e, 1).try_cast("bigint"), INTEGER)

    def _month(self, e: A.Node) -> Value:
        return Value(self._date_part(e, 2).try_cast("bigint"), INTEGER)

    def _day(self, e: A.Node) -> Value:
        return Value(self._date_part(e, 3).try_cast("bigint"), INTEGER)

    def _hours(self, e: A.Node) -> Value:
        return Value(self._date_part(e, 4).try_cast("bigint"), INTEGER)

    def _minutes(self, e: A.Node) -> Value:
        return Value(self._date_part(e, 5).try_cast("bigint"), INTEGER)

    def _seconds(self, e: A.Node) -> Value:
        return Value(self._date_part(e, 6).try_cast(V.DECIMAL), DEC)

    def _tz(self, e: A.Node) -> Value:
        return Value(self._date_part(e, 7), STRING)

    def _timezone(self, e: A.Node) -> Value:
        zone = self._date_part(e, 7)
        hours, minutes = F.regexp_extract(zone, r"^[+-](\d\d):", 1).try_cast("int"), F.regexp_extract(zone, r":(\d\d)$", 1).try_cast("int")
        body = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
        text = F.when((zone == "Z") | (hours + minutes == 0), "PT0S").when(zone != "", F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), body))
        return Value(V.typed_literal(text, f"{XSD}dayTimeDuration"), TERM)

    # --- hashes and identifiers -----------------------------------------------------------

    def _md5(self, e: A.Node) -> Value:
        return Value(F.md5(self.value(e).string), STRING)

    def _sha1(self, e: A.Node) -> Value:
        return Value(F.sha1(self.value(e).string), STRING)

    def _sha256(self, e: A.Node) -> Value:
        return Value(F.sha2(self.value(e).string, 256), STRING)

    def _sha384(self, e: A.Node) -> Value:
        return Value(F.sha2(self.value(e).string, 384), STRING)

    def _sha512(self, e: A.Node) -> Value:
        return Value(F.sha2(self.value(e).string, 512), STRING)

    def _struuid(self) -> Value:
        return Value(F.uuid(), STRING)

    def _uuid(self) -> Value:
        return Value(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")), TERM)

    # --- casts and functions by IRI ---------------------------------------------------------

    def _by_iri(self, name: str, args: tuple[A.Node, ...]) -> Value:
        name = name[1:-1]
        if name in self.context.functions:
            return Value(self.context.functions[name](*[self.value(a).term for a in args]), TERM)
        if name.startswith(XSD) and len(args) == 1:
            return self._cast(name.removeprefix(XSD), self.value(args[0]))
        return Value(null(), TERM)  # an unknown function is an error

    def _cast(self, to: str, v: Value) -> Value:
        if to == "string":
            return self._to_string(v)
        t = v.term
        # a string or an ill-formed literal has no number; its lexical form is what counts
        lex = F.trim(F.regexp_replace(v.string, r"[ \t\n\r]+", " "))
        n = v.number
        ranked = n is not None
        rank = None if not ranked else F.lit(n.rank) if isinstance(n.rank, int) else n.rank
        truth = v.boolean
        if to in INTEGERS:
            low, high = INTEGERS[to]
            whole = None
            if ranked:
                exact = F.when(n.approx >= 0, F.floor(n.exact)).otherwise(F.ceil(n.exact)) if n.exact is not None else null(V.DECIMAL)
                near = F.when(F.abs(n.approx) < 9.3e18, F.when(n.approx >= 0, F.floor(n.approx)).otherwise(F.ceil(n.approx)))
                whole = F.when(rank <= 2, exact.try_cast("bigint")).when(rank.isNotNull(), near.try_cast("bigint"))
            number = F.coalesce(*([whole] if whole is not None else []), F.when(truth, 1).when(~truth, 0).cast("bigint"))
            fits = lex.rlike(V._INTEGER_FORM) & lex.try_cast("bigint").between(low, min(high, (1 << 63) - 1))
            made = F.coalesce(F.when(fits, lex), F.when(number.between(low, min(high, (1 << 63) - 1)), number.cast("string")))
            if v.kind in ("integer", "double", "decimal", "boolean") and to == "integer":
                return Value(number.cast("bigint"), INTEGER)
            return Value(V.typed_literal(made, XSD + to), TERM)
        if to in ("decimal", "double", "float"):
            one = F.when(truth, 1).when(~truth, 0).cast("double")
            approx = F.coalesce(n.approx, one) if ranked else one
            if to == "decimal":
                exact = n.exact if ranked and n.exact is not None else null(V.DECIMAL)
                value = F.coalesce(exact.cast(V.DECIMAL), F.when(~F.isnan(approx), approx.try_cast(V.DECIMAL)))
                if v.kind != "term" and v.kind != "string":
                    return Value(value, DEC)
                good = lex.rlike(V._DECIMAL_FORM) & lex.try_cast(V.DECIMAL).isNotNull()
                return Value(F.coalesce(F.when(good, V.typed_literal(lex, f"{XSD}decimal")), V.to_term(value, DEC)), TERM)
            if to == "double" and v.kind not in ("term", "string"):
                return Value(approx, DOUBLE)
            good = V.parse_double(lex).isNotNull()
            made = V.double_text(approx.cast("float") if to == "float" else approx)
            return Value(F.coalesce(F.when(good, V.typed_literal(lex, XSD + to)), V.typed_literal(made, XSD + to)), TERM)
        if to == "boolean":
            from_number = F.when(F.isnan(n.approx) | (n.approx == 0), False).when(n.approx.isNotNull(), True) if ranked else null("boolean")
            return Value(F.coalesce(truth, from_number, F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)), BOOLEAN)
        if to in ("dateTime", "dateTimeStamp"):
            if v.kind == "dateTime" and to == "dateTime":
                return v
            own = F.when(v.instant.isNotNull(), v.lex)
            text = F.coalesce(own, F.when(V.instant(lex).isNotNull(), lex))
            return Value(V.typed_literal(text, XSD + to), TERM)
        forms = {
            "date": V.DATE_FORM, "time": r"^\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$", "gYear": r"^-?\d{4,}(Z|[+-]\d\d:\d\d)?$", "gYearMonth": r"^-?\d{4,}-\d\d(Z|[+-]\d\d:\d\d)?$",
            "gMonth": r"^--\d\d(Z|[+-]\d\d:\d\d)?$", "gMonthDay": r"^--\d\d-\d\d(Z|[+-]\d\d:\d\d)?$", "gDay": r"^---\d\d(Z|[+-]\d\d:\d\d)?$",
            "duration": r"^-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$", "dayTimeDuration": r"^-?P(?=.)(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$", "yearMonthDuration": r"^-?P(?=.)(\d+Y)?(\d+M)?$",
        }
        if to not in forms:
            return Value(null(), TERM)
        own = F.when(v.datatype == XSD + to, v.lex)
        text = F.coalesce(own, lex)
        return Value(F.when(text.rlike(forms[to]), V.typed_literal(text, XSD + to)), TERM)

    def _to_string(self, v: Value) -> Value:
        if v.kind in ("string", "iri"):
            return Value(v.col if v.kind == "string" else F.concat(F.lit(v.rep.prefix), v.col.cast("string")), STRING)
        t = v.term
        n = v.number
        plain = F.when(v.suffix == "", v.lex).when(t.startswith("<") & ~t.startswith("<<("), t.substr(F.lit(2), F.length(t) - 2))
        if n is not None:
            rank = F.lit(n.rank) if isinstance(n.rank, int) else n.rank
            exact = F.regexp_replace(V.decimal_text(n.exact.cast(V.DECIMAL)), r"\.0$", "") if n.exact is not None else null()
            x = n.approx
            ordinary = (F.abs(x) >= 1e-6) & (F.abs(x) < 1e6)
            shown = F.when(x == 0, "0").when(ordinary, F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", "")).otherwise(V.double_text(x))
            plain = F.coalesce(F.when(rank <= 2, exact).when(rank >= 3, shown), plain)
        truth = v.boolean
        other = F.when(~v.suffix.startswith("@"), v.lex)
        return Value(F.coalesce(truth.cast("string"), plain, other), STRING)


def _whole_float(f):
    return lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | (F.abs(x) > 9e15), x).otherwise(f(x).cast("double"))


def triple_part(term: Column, at: int) -> Column:
    """Subject, predicate or object of a triple term; NULL for other terms."""

    @F.pandas_udf("string")
    def part(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else (triple_parts(x) or (None, None, None))[at])

    return part(term)


_XML_CLASSES = {r"\i": r"[\p{L}_:]", r"\c": r"[\p{L}\p{N}._:\-]", r"\I": r"[^\p{L}_:]", r"\C": r"[^\p{L}\p{N}._:\-]"}


def java_regex(pattern: str, flags: str) -> tuple[str, str]:
    """An XPath regular expression in Java's syntax; the second part says ``invalid`` where it or the flags are."""
    if set(flags) - set("smixq"):
        return "", "invalid"
    if "q" in flags:
        pattern = re.escape(pattern)
    else:
        if re.search(r"\(\?(?!:)|\\[bBAzZGQE]|[*+?}]\+", pattern):
            return "", "invalid"
        for mark, found in _XML_CLASSES.items():
            pattern = pattern.replace(mark, found)
        if "x" in flags:
            pattern = re.sub(r"[ \t\n\r]+", "", pattern)
        if "m" not in flags:
            pattern = re.sub(r"(?<!\\)\$(?![^\[]*\])", r"\\z", pattern)
    try:
        re.compile(re.sub(r"\\[pP]\{\w+\}", r"\\w", pattern).replace(r"\z", r"\Z"))
    except re.error:
        return "", "invalid"
    marks = "".join(f for f in "smi" if f in flags) + ("u" if "i" in flags else "")
    return (f"(?{marks})" if marks else "") + pattern, ""


def _matches_empty(pattern: str) -> bool:
    try:
        return re.search(re.sub(r"^\(\?[a-z]+\)", "", re.sub(r"\\[pP]\{\w+\}", r"\\w", pattern)).replace(r"\z", r"\Z"), "") is not None
    except re.error:
        return True


def python_search(text: str, pattern: str, flags: str) -> bool | None:
    found, bad = java_regex(pattern, flags)
    if bad:
        return None
    try:
        return re.search(re.sub(r"\\[pP]\{\w+\}", r"\\w", found).replace(r"\z", r"\Z").replace("(?iu)", "(?i)"), text) is not None
    except re.error:
        return None

