"""Assignment-aware secret scan.

A text is lexed into tokens: names (dotted ones whole), string literals of every common
quoting (single, double, back-quoted, tripled, with escapes and prefixes), operators,
brackets, marks of comments and line ends. A parser over the tokens finds name-literal
pairs: ``name = literal``, ``name: literal``, ``name := literal``, ``name => literal``,
quoted and subscripted names, annotated and declared ones, ``export NAME=...``,
``#define NAME literal``, ``setenv NAME literal``, ``<name>literal</name>`` and
``("name", "literal")``. A value is a sequence of literals and names joined by ``+`` or set
side by side, also behind a cast, a conversion call or a comment. Constants propagate: a
name takes the literals last bound to it earlier in the text, dotted names by their last
part if need be, so ``self.k = "..."; api_key = self.k`` reports the literal of ``k``.
Comments and the insides of strings are lexed as text of their own, so what is assigned
there counts. A literal is scored by what the names bound to it say (sensitive words,
whole or as parts of a compound name) and by its own form (length, character classes,
entropy, a private key's head line); literals above ``THRESHOLD`` become ``lexed`` spans.
A value that is made of others keeps references to them and its last
``WINDOW`` literals, whose forms are judged together; what lies further back is judged with
the value it came from. So every step is linear in the text, however names take each other's
values, and nothing has a length limit. Three base kinds are always reported:

* assign: ``(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)``
  in either case of ASCII letters, kept where group 2 has 8 characters or more;
* access: ``AKIA[A-Z0-9]+`` of 16 characters or more;
* hex: ``[0-9a-f]+`` of 32 characters or more;

each found leftmost and without overlaps, the short ones dropped afterwards. Spans are
code points, end exclusive.

Defined cases: a null text is the empty text and has no spans; texts are scanned whole;
repeated rows are scanned each; a string that its line does not close is no string; of
several bindings of a name the last one before its use counts; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the same as dropping the shorter ones
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "lexed")

#: Words that make a name sensitive, and how strongly.
NAME_WEIGHT = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "key": 0.4, "private": 0.5, "access": 0.4, "api": 0.4,
    "signing": 0.4, "encryption": 0.4, "session": 0.3, "bearer": 0.6, "salt": 0.5, "cert": 0.3, "client": 0.2,
}
THRESHOLD = 1.2

#: A text without one of these can't have a sensitive name.
STEMS = tuple(w for w in NAME_WEIGHT if not any(v in w for v in NAME_WEIGHT if v != w))

_NAME = r"[A-Za-z_$][A-Za-z0-9_]*+(?:(?:\.|->|::|-|\?\.)[A-Za-z_][A-Za-z0-9_]*+)*+"
_TOKEN = re.compile(
    r"""(?P<skip>\\[\s\S])"""
    r"""|(?P<string>(?<![A-Za-z0-9_])(?:[bBrRfFuUL]{1,2}|@)?(?:"""
    r'''"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+"{3}'''
    r"""|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}"""
    r'''|"(?:[^"\\\n]|\\[\s\S])*+"'''
    r"""|'(?:[^'\\\n]|\\[\s\S])*+'"""
    r"""|`(?:[^`\\]|\\[\s\S])*+`))"""
    r"""|(?P<word>\#[ \t]*define\b|\b(?:setenv|ENV)[ \t])"""
    rf"""|(?P<name>{_NAME})"""
    r"""|(?P<open>/\*|<!--)|(?P<close>\*/|-->)"""
    r"""|(?P<op>:=|=>|\+=|[=!<>]=|[=:])"""
    r"""|(?P<mark>[+(){}\[\],;<>])"""
    r"""|(?P<end>\n)"""
    r"""|(?P<other>[^\s"'`\\A-Za-z_$#/<*:=!>+(){}\[\],;-]++)""",
    re.ASCII,
)
_BARE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>([^<>]*+)</\1\s*>")
_INSIDE = re.compile(r"[:=<]")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Calls that hand their argument on.
CONVERSIONS = frozenset("str string bytes bytearray unicode text secret secretstr secretstring b64decode encode decode trim strip from valueof".split())
#: Words after which a name and a colon begin a block.
STATEMENTS = frozenset("if elif while for in is not and or except with case class def lambda else return".split())
_PEM = re.compile(r"\s*-----BEGIN [A-Z ]*PRIVATE KEY-----")


def name_score(name: str) -> float:
    """How sensitive a target name is: the sum over its words, at most 1.5."""
    words = [w.lower() for w in _PART.findall(name)]
    score = sum(NAME_WEIGHT.get(w, 0.0) for w in words)
    return min(1.5, max(score, NAME_WEIGHT.get("".join(words), 0.0)))


def literal_score(text: str) -> float:
    """How much a literal looks like a credential, 0 to 1; its line breaks and their indents don't count."""
    if "\n" in text:
        if _PEM.match(text):
            return 1.0
        text = "".join(line.strip().removesuffix("\\") for line in text.split("\n"))
    n = len(text)
    if n < 8 or " " in text:
        return 1.0 if _PEM.match(text) else 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    classes = sum(any(f(c) for c in text) for f in (str.islower, str.isupper, str.isdigit))
    return min(1.0, entropy / 4.5) * (0.4 + 0.2 * classes)


Span = tuple[int, int]
#: Literals of one value whose form is judged together.
WINDOW = 16


class Value:
    """A sequence of literals: its last ones, and the values that it was made of if there are more.

    ``weight`` is what the names bound to it say, the most sensitive one.
    """

    __slots__ = ("count", "kids", "tail", "weight")

    def __init__(self, tail: tuple[Span, ...], count: int, kids: tuple[Value, ...] = ()):
        self.tail, self.count, self.kids, self.weight = tail, count, kids, 0.0


class Values:
    """All values of a text, each after those that it was made of."""

    def __init__(self):
        self.all: list[Value] = []

    def _new(self, *args) -> Value:
        self.all.append(Value(*args))
        return self.all[-1]

    def literal(self, span: Span) -> Value:
        return self._new((span,), 1)

    def joined(self, parts: list[Value]) -> Value | None:
        """The parts in a row."""
        if len(parts) < 2:
            return parts[0] if parts else None
        count, tail = sum(p.count for p in parts), []
        for p in reversed(parts):
            tail = [*p.tail[-(WINDOW - len(tail)) :], *tail]
            if len(tail) >= WINDOW:
                break
        if count <= WINDOW:
            return self._new(tuple(tail), count)
        kids = parts if len(parts) <= WINDOW else [self.joined(parts[k : k + WINDOW]) for k in range(0, len(parts), WINDOW)]
        return self._new(tuple(tail), count, tuple(kids))


#: Between two terms: either may be the value.
_CHOICE = re.compile(r"\?|\|\|")
CHOICES = frozenset(["or", "else", "and", "orelse", "default"])
#: Calls whose last argument is the value if there is no other.
LOOKUPS = frozenset("getenv get getorelse getordefault getattr env environ getproperty getstring config default".split())
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[0-9]?[+-]?[ \t]*(?:#[^\n]*)?\n")


class Lexer:
    """Tokens of one piece of text and the pairs that they make.

    ``kind`` and ``at`` hold the kinds and spans of the tokens that matter; ``text`` is the
    whole document, so spans need no shifting for pieces inside comments and strings.
    """

    def __init__(self, text: str, begin: int, end: int, values: Values):
        self.text, self.kind, self.at, self.values = text, [], [], values
        self.inside: list[Span] = []
        for m in _TOKEN.finditer(text, begin, end):
            kind = m.lastgroup
            if kind == "string":
                body = self._body(*m.span())
                if _INSIDE.search(text, *body):
                    self.inside.append(body)
            elif kind in ("skip", "other"):
                continue
            self.kind.append(kind if kind != "mark" and kind != "op" else m[0])
            self.at.append(m.span())
        self.kind.append("end")
        self.at.append((end, end))
        self.begins = [a for a, _ in self.at]
        #: For an opening mark of a comment, the token after its closing mark.
        self.after: dict[int, int] = {}
        last = None
        for k in range(len(self.kind) - 1, -1, -1):
            if self.kind[k] == "close":
                last = k + 1
            elif self.kind[k] == "open" and last is not None:
                self.after[k] = last

    def _body(self, a: int, b: int) -> Span:
        """The inside of a string token, without prefix and quotes."""
        quote = self.text[b - 1]
        a = self.text.index(quote, a, b)
        n = 3 if b - a >= 6 and self.text.startswith(quote * 3, a) and self.text.endswith(quote * 3, a + 3, b) else 1
        return a + n, b - n

    def _near(self, k: int) -> bool:
        """Whether token k follows the one before it on the same line, but for blanks."""
        return k > 0 and not self.text[self.at[k - 1][1] : self.at[k][0]].strip(" \t")

    def _target(self, k: int) -> str | None:
        """The name that the operator at token k assigns to."""
        kind, text = self.kind, self.text
        if k == 0 or not self._near(k):
            return None
        j = k - 1
        if kind[j] == "]":  # name["key"] or name[] or name[3]
            if j >= 2 and kind[j - 1] == "string" and kind[j - 2] == "[":
                return text[slice(*self._body(*self.at[j - 1]))]
            while j >= 0 and kind[j] != "[" and k - j < 4:
                j -= 1
            j -= 1
        if j < 0:
            return None
        if kind[j] == "name":
            if kind[k] == ":" and self._near(j) and kind[j - 1] == "name" and text[slice(*self.at[j - 1])] in STATEMENTS:
                return None
            return text[slice(*self.at[j])]
        return text[slice(*self._body(*self.at[j]))] if kind[j] == "string" else None

    def _skip(self, k: int) -> int:
        """The first token from k on that is no comment."""
        while k in self.after:
            k = self.after[k]
        return k

    def value(self, k: int, bound: dict[str, Value]) -> tuple[Value | None, int]:
        """(literals of the expression at token k, the token after it)."""
        kind, text = self.kind, self.text
        parts: list[Value] = []
        while True:
            k = self._skip(k)
            # Casts, brackets and conversion calls before a term.
            while True:
                if kind[k] == "(" and kind[k + 1 : k + 3] == ["name", ")"]:
                    k += 3
                elif kind[k] == "(":
                    k += 1
                elif kind[k] == "name" and kind[k + 1] == "(" and _last(text[slice(*self.at[k])]).lower() in CONVERSIONS:
                    k += 2
                else:
                    break
                k = self._skip(k)
            if kind[k] == "string":
                parts.append(self.values.literal(self._body(*self.at[k])))
                k += 1
                while kind[k] == "string" and self._near(k):  # literals side by side
                    parts.append(self.values.literal(self._body(*self.at[k])))
                    k += 1
            elif kind[k] == "name":
                name = text[slice(*self.at[k])]
                known = bound.get(name) or bound.get(_last(name))
                if known is None or kind[k + 1] in ("(", "["):
                    break
                parts.append(known)
                k += 1
            else:
                break
            more = k
            while kind[more] == ")":
                more += 1
            if kind[more] == "end" and kind[more + 1 : more + 2] == ["+"]:
                more += 1
            if kind[more] != "+":
                break
            k = more + 1
            if kind[k] == "end" and k + 1 < len(kind):
                k += 1
        return self.values.joined(parts), k

    def choices(self, k: int, bound: dict[str, Value]) -> tuple[list[Value], int]:
        """(values that the expression at token k may have, the token after it) for a choice or a lookup's default."""
        kind, text = self.kind, self.text
        found: list[Value] = []
        depth, offered, asked, calls = 0, False, False, []
        begin = k
        while k < len(kind) - 1 and kind[k] not in ("end", ";", "=", ":=", "=>", "+="):
            gap = text[self.at[k - 1][1] : self.at[k][0]] if k > begin else ""
            if _CHOICE.search(gap):
                offered, asked = True, asked or "?" in gap
            what = kind[k]
            if what in "([{":
                calls.append(kind[k - 1] == "name" and k > begin and _last(text[slice(*self.at[k - 1])]).lower() in LOOKUPS)
                depth += 1
            elif what in ")]}":
                depth -= 1
                if depth < 0:
                    break
                calls.pop()
            elif what == ",":
                if depth == 0:
                    break
                offered = calls[-1]
            elif what == ":" and asked:
                offered = True
            elif what == "name" and text[slice(*self.at[k])].lower() in CHOICES:
                offered = True
            elif what == "string":
                here = offered or (k == begin and kind[k + 1] == "name" and text[slice(*self.at[k + 1])] == "if")
                if here and (depth == 0 or calls[-1]):
                    value, after = self.value(k, bound)
                    found.append(value)
                    offered, k = False, max(after, k + 1)
                    continue
                offered = False
            elif what == "name" and offered and (depth == 0 or calls[-1]) and kind[k + 1] not in ("(", "["):
                name = text[slice(*self.at[k])]
                known = bound.get(name) or bound.get(_last(name))
                if known is not None:
                    found.append(known)
                    offered = False
            k += 1
        return found, k

    def targets(self, k: int) -> list[str]:
        """The names of a tuple that the equals sign at token k assigns to, from the beginning of its line; empty if there is one name."""
        kind, text = self.kind, self.text
        names, j = [], k - 1
        while j >= 0 and kind[j] == "name" and self._near(j + 1):
            names.append(text[slice(*self.at[j])])
            if j == 0 or kind[j - 1] in ("end", ";"):
                return names[::-1] if len(names) > 1 else []
            if kind[j - 1] != ",":
                return []
            j -= 2
        return []

    def block(self, at: int, end: int, key: int) -> Span | None:
        """The indented lines of a block scalar that ``|`` or ``>`` at ``at`` opens for the key at ``key``."""
        m = _BLOCK.match(self.text, at, end)
        if not m:
            return None
        line = self.text.rfind("\n", 0, key) + 1
        margin = len(self.text[line:key]) - len(self.text[line:key].lstrip(" -"))
        first, last, at = None, None, m.end()
        while at < end:
            stop = self.text.find("\n", at, end)
            stop = end if stop < 0 else stop
            row = self.text[at:stop]
            bare = row.strip()
            if bare:
                if len(row) - len(row.lstrip(" \t")) <= margin:
                    break
                first = at + row.index(bare) if first is None else first
                last = at + row.index(bare) + len(bare)
            at = stop + 1
        return None if first is None else (first, last)

    def bare(self, at: int, end: int) -> Span | None:
        """An unquoted value that begins at ``at``; no call, index or tag."""
        m = _BARE.match(self.text, at, end)
        if not m or self.text[m.end() : m.end() + 1] in ("(", "[", "{", "<"):
            return None
        return m.span()


def _last(name: str) -> str:
    return re.split(r"\.|->|::", name)[-1]


def pairs(text: str, values: Values):
    """(name, value) of every binding in order."""
    bound: dict[str, Value] = {}
    todo = [(0, len(text))]

    def bind(name, value):
        if value is None:
            bound.pop(name, None)
            return
        bound[name] = value
        bound[_last(name)] = value

    for begin, end in todo:
        lex = Lexer(text, begin, end, values)
        todo += lex.inside
        barren = 0  # tokens before it hold no choice
        kind, at = lex.kind, lex.at
        k = 0
        while k < len(kind) - 1:
            what = kind[k]
            name = None
            start = k + 1
            stated = None
            if what in ("=", ":", ":=", "=>", "+="):
                name = lex._target(k)
                if what == ":" and name is not None:  # an annotation: the value comes after its equals sign
                    j = k + 1
                    while kind[j] in ("name", "[", "]", ",") and j - k < 8:
                        j += 1
                    if kind[j] == "=" and j > k + 1:
                        start, stated = j + 1, j
            elif what == "word" and kind[k + 1] == "name":
                name, start = text[slice(*at[k + 1])], k + 2
            elif what == "," and k >= 2 and kind[k - 1] == "string" and kind[k - 2] in ("(", "[", "{") and kind[k + 1] == "string":
                name = text[slice(*lex._body(*at[k - 1]))]
            if name is None:
                k += 1
                continue
            if what in ("=", ":="):
                names = lex.targets(k)
                if names:
                    own, j = [], k + 1
                    while len(own) < len(names):
                        value, j = lex.value(j, bound)
                        while kind[j] not in (",", "end", ";") and j < len(kind) - 1:
                            j += 1
                        own.append(value)
                        if kind[j] != ",":
                            break
                        j += 1
                    if len(own) == len(names):
                        for n, value in zip(names, own):
                            bind(n, value)
                            if value is not None:
                                yield n, value
                        k = max(j, k + 1)
                        continue
            first = lex._skip(start)
            blank = text[at[start - 1][1] : at[first][0]] if first == start else ""
            value, after = lex.value(first, bound)
            more, beyond = lex.choices(first, bound) if "\n" not in blank and first >= barren else ([], after)
            if not more:
                barren = max(barren, beyond)
            else:
                after = max(after, beyond)
                for other in more:
                    yield name, other
                if value is None:
                    value = more[0]
            if value is None:
                # Unquoted: what stands right after the operator on its line, or a block below it.
                a = at[start - 1][1]
                while a < end and text[a] in " \t":
                    a += 1
                span = lex.bare(a, end)
                if "\n" in blank:
                    span = None
                if span is None and what == ":":
                    span = lex.block(a, end, at[k - 1][0])
                if span:
                    value = values.literal(span)
                    after = max(after, bisect_right(lex.begins, span[1] - 1))
            if what == "+=" and value is not None and name in bound:
                value = values.joined([bound[name], value])
            k = max(after, start) if stated is None else stated  # what stands before the equals sign is a target, too
            bind(name, value)
            if value is not None:
                yield name, value
    for m in _TAG.finditer(text):
        a, b = m.span(2)
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if a < b:
            yield m[1], values.literal((a, b))


def lexed_spans(text: str) -> list[Span]:
    """Literals whose names and form score at least THRESHOLD together."""
    low = text.lower()
    if not any(w in low for w in STEMS):
        return []
    values = Values()
    for name, value in pairs(text, values):
        value.weight = max(value.weight, name_score(name))
    score: dict[Span, float] = {}
    for value in reversed(values.all):  # a value comes before those that are made of it
        if not value.weight:
            continue
        for kid in value.kids:
            kid.weight = max(kid.weight, value.weight)
        form = literal_score("".join(text[a:b] for a, b in value.tail))
        for s in value.tail:
            if form and s[1] > s[0]:
                score[s] = max(score.get(s, 0.0), value.weight + form)
    return sorted(s for s, x in score.items() if x >= THRESHOLD)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind as listed in KINDS."""
    if not text:
        return []
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    out += [("lexed", a, b) for a, b in lexed_spans(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping ones merged) replaced by ``mark``."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``spans`` as an array of (kind, start, stop)."""
    schema = pa.schema([("id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))])

    def run(batches):
        for b in batches:
            for part in range(0, b.num_rows, 512):
                x = b.slice(part, 512)
                spans = [[{"kind": k, "start": a, "stop": z} for k, a, z in scan(t)] for t in x.column(1).to_pylist()]
                yield pa.record_batch([x.column(0), pa.array(spans, schema.field(1).type)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, "id long, spans array<struct<kind:string,start:long,stop:long>>"
    ).withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the text and the count of characters renewed.

    Only rows that a base kind or a sensitive name could touch pass through Python.
    """

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(redact)

    low = F.lower(F.col(text_col))
    suspect = F.col(text_col).rlike(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    for w in STEMS:
        suspect = suspect | low.contains(w)
    out = docs.withColumn(text_col, F.when(suspect, clean(F.col(text_col))).otherwise(F.col(text_col)))
    return out.withColumn(count_col, F.length(text_col).cast("long")) if count_col in docs.columns else out


def op10_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_documents(docs)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s.kind.isin(*BASE))), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def base_digest(text: str | None) -> str:
    return hashlib.sha256(joined(s for s in scan(text) if s[0] in BASE).encode()).hexdigest()
