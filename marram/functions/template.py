"""The path-template language, compiled to column expressions.

``$field``, ``${field}``, ``%name{argument,...}``, ``$$`` and ``%%`` are read once on the
driver; what comes out is one expression for all rows, so rendering is a projection.
Functions that need Unicode tables (title, asciify, sanitize) are Arrow-batched.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import stripped
from .text import folded_path_column, without_marks

MAX_DEPTH = 100
JOIN = ", "
#: Short names of fields.
ALIASES = {"albumartist": "album_artist", "track": "track_no", "tracktotal": "track_total", "disc": "disc_no", "disctotal": "disc_total", "albumtype": "compilation", "catalognum": "catalog_number"}
#: Letters that have no decomposition.
PLAIN = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L"}
#: Characters and names that file systems reserve.
RESERVED = re.compile(r'[<>:"/\\|?*\x00-\x1f]')
DEVICES = {"CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10))}
#: Least and most arguments of each function.
ARGUMENTS = {"upper": (1, 1), "lower": (1, 1), "title": (1, 1), "left": (2, 2), "right": (2, 2), "if": (2, 3), "ifdef": (1, 3), "asciify": (1, 1), "time": (2, 2), "first": (1, 1), "the": (1, 2), "pad": (2, 2), "default": (2, 2), "sanitize": (1, 1)}

_PIECE = re.compile(r"\$\$|%%|\$\{(?P<braced>[^}]*)\}|\$\{|\$(?P<field>[A-Za-z_]\w*)|%(?P<call>[A-Za-z_]\w*)(?P<open>\{?)|(?P<comma>,)|(?P<close>\})|(?P<text>[^$%,}]+|[$%])", re.A)


class TemplateError(ValueError):
    """A template that cannot be read; ``offset`` is where."""

    def __init__(self, message: str, offset: int):
        super().__init__(f"{message} at {offset}")
        self.offset = offset


def parse(source: str) -> list:
    """Nodes: a text, ("field", name) or ("call", name, [arguments], offset)."""
    top: list = []
    # Open calls, innermost last: (name, offset, finished arguments, argument being read).
    stack: list[tuple[str, int, list, list]] = []
    for m in _PIECE.finditer(source):
        target = stack[-1][3] if stack else top
        whole = m[0]
        if m["text"] is not None or whole in ("$$", "%%"):
            target.append(m["text"] if m["text"] is not None else whole[0])
        elif whole == "${":
            raise TemplateError("a ${ is not closed", m.start())
        elif m["braced"] is not None or m["field"]:
            name = m["field"] or m["braced"]
            if not re.fullmatch(r"[A-Za-z_]\w*", name, re.A):
                raise TemplateError(f"{name!r} is no field name", m.start())
            target.append(("field", name))
        elif m["call"]:
            if not m["open"]:
                raise TemplateError(f"%{m['call']} lacks its {{", m.start())
            if len(stack) >= MAX_DEPTH:
                raise TemplateError("calls are nested too deep", m.start())
            stack.append((m["call"], m.start(), [], []))
        elif not stack:
            raise TemplateError(f"a {whole!r} outside a call", m.start())
        elif m["comma"]:
            name, at, done, own = stack[-1]
            stack[-1] = (name, at, [*done, own], [])
        else:
            name, at, done, own = stack.pop()
            (stack[-1][3] if stack else top).append(("call", name, [*done, own] if done or own else [], at))
    if stack:
        raise TemplateError(f"%{stack[-1][0]} is not closed", stack[-1][1])
    return top


def capitalised(text: str) -> str:
    return re.sub(r"[^ -]+", lambda m: _first_letter(m[0]), text)


def _first_letter(word: str) -> str:
    k = next((i for i, ch in enumerate(word) if ch.isalpha()), len(word))
    return word[:k].lower() + word[k : k + 1].upper() + word[k + 1 :].lower()


def clamp(text: str, limit: int = 255) -> str:
    """At most ``limit`` UTF-8 bytes; no character and no mark with its base is cut."""
    raw = text.encode("utf-8", "replace")
    if len(raw) <= limit:
        return text
    out = raw[:limit].decode("utf-8", "ignore")
    return out.rstrip("".join(c for c in set(out) if unicodedata.combining(c))) if out and unicodedata.combining(out[-1]) else out


def safe_component(text: str, replacements: tuple[tuple[str, str], ...] = (), limit: int = 255) -> str:
    """A file name that every file system takes."""
    for pattern, by in replacements:
        text = re.sub(pattern, by, text)
    text = unicodedata.normalize("NFC", RESERVED.sub("_", text)).rstrip(". ")
    if (text.rpartition(".")[0] or text).upper() in DEVICES:
        text = "_" + text
    return clamp(text, limit)


def _on_values(f):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return run


title_column = _on_values(capitalised)
asciify_column = _on_values(lambda t: without_marks("".join(PLAIN.get(c, c) for c in t)))
sanitize_column = _on_values(safe_component)
clamp_column = _on_values(clamp)

#: Strftime directives and Spark's patterns.
_DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "y": "yy", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "H": "HH", "M": "mm", "S": "ss"}


def _pattern(fmt: str) -> str:
    out = ""
    for m in re.finditer(r"%(.)|([^%]+)|%", fmt):
        if m[1] in _DIRECTIVES:
            out += _DIRECTIVES[m[1]]
        else:
            text = m[2] or (m[1] if m[1] == "%" else m[0])
            out += "'" + text.replace("'", "''") + "'"
    return out


def stringify(name: str, kind: str) -> Column:
    """A field as text: null is empty, true is 1 and false empty, lists are joined."""
    c = F.col(name)
    if kind.startswith("array"):
        return F.coalesce(F.array_join(c, JOIN), F.lit(""))
    if kind == "boolean":
        return F.when(c, "1").otherwise("")
    return F.coalesce(c.cast("string"), F.lit(""))


class Template:
    """A template bound to a table's columns; ``value`` is the text, ``problem`` an error or null."""

    def __init__(self, source: str, df: DataFrame):
        self.kinds = dict(df.dtypes)
        self.problems: list[Column] = []
        self.value = self._join(parse(source))
        self.problem = F.coalesce(*self.problems, F.lit(None).cast("string")) if self.problems else F.lit(None).cast("string")

    def _join(self, nodes: list) -> Column:
        parts = [self._node(n) for n in nodes]
        return F.concat(*parts) if parts else F.lit("")

    def _field(self, name: str) -> str | None:
        name = name if name in self.kinds else ALIASES.get(name, name)
        return name if name in self.kinds else None

    def _node(self, node) -> Column:
        if isinstance(node, str):
            return F.lit(node)
        if node[0] == "field":
            name = self._field(node[1])
            return stringify(name, self.kinds[name]) if name else F.lit("")
        _, name, args, at = node
        if name not in ARGUMENTS:
            raise TemplateError(f"no function %{name}", at)
        least, most = ARGUMENTS[name]
        if not least <= len(args) <= most:
            raise TemplateError(f"%{name} takes {least} to {most} arguments", at)
        if name == "ifdef":
            return self._ifdef(args, at)
        if name == "if":
            # Problems inside a branch count only where the branch is taken.
            cond = stripped(self._join(args[0])) != ""
            return self._branch(cond, [args[1], args[2] if len(args) > 2 else []])
        return getattr(self, f"_{name}")(*[self._join(a) for a in args], *([args[1]] if name == "time" else []))

    def _branch(self, cond: Column, sides: list) -> Column:
        values, outer = [], self.problems
        for side, holds in zip(sides, (cond, ~cond), strict=True):
            self.problems = []
            values.append(self._join(side))
            outer += [F.when(holds, p) for p in self.problems]
        self.problems = outer
        return F.when(cond, values[0]).otherwise(values[1])

    def _ifdef(self, args: list, at: int) -> Column:
        if len(args[0]) != 1 or not isinstance(args[0][0], str):
            raise TemplateError("%ifdef takes a bare field name", at)
        name = self._field(args[0][0])
        if name is None:
            return self._join(args[2]) if len(args) > 2 else F.lit("")
        raw = F.array_join(name, JOIN) if self.kinds[name].startswith("array") else F.initcap(F.col(name).cast("string")) if self.kinds[name] == "boolean" else F.col(name).cast("string")
        if len(args) == 1:
            return F.coalesce(raw, F.lit(""))
        return self._branch(F.col(name).isNotNull(), [args[1], args[2] if len(args) > 2 else []])

    def _number(self, n: Column, function: str) -> Column:
        value = F.when(stripped(n).rlike(r"^[+-]?[0-9]{1,9}$"), stripped(n).try_cast("int"))
        self.problems.append(F.when(value.isNull(), F.concat(F.lit(f"%{function}: "), n, F.lit(" is no number"))))
        return value

    def _upper(self, a: Column) -> Column:
        return F.upper(a)

    def _lower(self, a: Column) -> Column:
        return F.lower(a)

    def _title(self, a: Column) -> Column:
        return title_column(a)

    def _left(self, a: Column, n: Column) -> Column:
        k = self._number(n, "left")
        return F.when(k >= 0, F.substring(a, F.lit(1), k)).otherwise(F.substring(a, F.lit(1), F.greatest(F.length(a) + k, F.lit(0))))

    def _right(self, a: Column, n: Column) -> Column:
        k = self._number(n, "right")
        return F.when(k > 0, F.right(a, k)).otherwise("")

    def _asciify(self, a: Column) -> Column:
        return asciify_column(a)

    def _time(self, a: Column, fmt: Column, nodes: list) -> Column:
        if not all(isinstance(n, str) for n in nodes):
            raise TemplateError("%time takes a fixed format", 0)
        d = F.trim(a)
        day = F.coalesce(*[F.when(d.rlike(p), F.try_to_timestamp(d, F.lit(f))) for p, f in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}-\d{1,2}$", "yyyy-M"), (r"^\d{4}$", "yyyy"))])
        self.problems.append(F.when((d != "") & day.isNull(), F.concat(F.lit("%time: no date: "), d)))
        return F.when(d == "", "").otherwise(F.date_format(day, _pattern("".join(nodes))))

    def _first(self, a: Column) -> Column:
        return F.split_part(a, F.lit(JOIN), F.lit(1))

    def _the(self, a: Column, mode: Column | None = None) -> Column:
        article, rest = F.regexp_extract(a, "^(The|the|An|an|A|a) ", 1), F.regexp_replace(a, "^(The|the|An|an|A|a) ", "")
        moved = F.concat(rest, F.lit(", "), article)
        return F.when(article == "", a).otherwise(moved if mode is None else F.when(F.lower(F.trim(mode)) == "strip", rest).otherwise(moved))

    def _pad(self, a: Column, n: Column) -> Column:
        width = self._number(n, "pad")
        sign = F.regexp_extract(a, "^([+-])", 1)
        body = F.regexp_replace(a, "^[+-]", "")
        zeros = F.repeat(F.lit("0"), F.greatest(width - F.length(a), F.lit(0)))
        return F.concat(sign, zeros, body)

    def _default(self, a: Column, b: Column) -> Column:
        return F.when(a != "", a).otherwise(b)

    def _sanitize(self, a: Column) -> Column:
        return sanitize_column(a)


def render(df: DataFrame, source: str, directories: bool = True) -> DataFrame:
    """``df`` with ``rendered`` (a safe relative path) and ``problem`` (null if there is none)."""
    t = Template(source, df)
    raw = df.withColumn("_raw", F.coalesce(t.value, F.lit(""))).withColumn("_problem", t.problem)
    parts = F.split("_raw", "/")
    problem = F.coalesce(
        "_problem",
        F.when(F.lit(not directories) & F.contains(F.col("_raw"), F.lit("/")), "a directory where none is allowed"),
        F.when(F.exists(parts, lambda x: stripped(x) == ""), "an empty component"),
    )

    @F.pandas_udf("string")
    def safe(s: pd.Series) -> pd.Series:
        return s.map(lambda p: None if p is None else "/".join(map(safe_component, p.split("/"))))

    return raw.withColumn("problem", problem).withColumn("rendered", F.when(F.col("_problem").isNotNull(), "").when(F.col("problem").isNull(), safe("_raw")).otherwise(F.col("_raw"))).drop("_raw", "_problem")


def colliding(rendered: DataFrame, id_: str = "id", path: str = "rendered", batch: str = "in_batch") -> DataFrame:
    """(path_key, id) of the rows whose path another row claims too, one of the batch at least."""
    keyed = rendered.filter(F.col(path).isNotNull()).select(id_, batch, folded_path_column(F.col(path)).alias("path_key"))
    many = keyed.groupBy("path_key").agg(F.min(id_).alias("_low"), F.max(id_).alias("_high"), F.bool_or(batch).alias("_any")).filter("_any and _low < _high")
    return keyed.join(many.select("path_key"), "path_key", "left_semi").select("path_key", id_).distinct()


def collisions(rendered: DataFrame, id_: str = "id", path: str = "rendered", batch: str = "in_batch") -> DataFrame:
    """(path_key, ids): paths that several rows claim, one of the batch at least."""
    return colliding(rendered, id_, path, batch).groupBy("path_key").agg(F.array_sort(F.collect_list(id_)).alias("ids"))


def choose_template(overrides: list[tuple[Column, str]], singleton: Column, singleton_name: str, album_name: str, forced: str | None = None) -> Column:
    """Name of the template of a row: forced, else the first override that fits, else by kind."""
    if forced:
        return F.lit(forced)
    fits = [F.when(cond, name) for cond, name in overrides]
    return F.coalesce(*fits, F.when(singleton, singleton_name).otherwise(album_name))


def rename_preview(tracks: DataFrame, library: DataFrame, source: str, root: str) -> DataFrame:
    """Current and new path of each track of a batch, its problem, and whether another row claims the path.

    The extension is kept and the last component holds 255 bytes with it.  ``library`` holds
    every path there is, those of missing tracks too.
    """
    relative = F.when(F.startswith("path", F.lit(root.rstrip("/") + "/")), F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path"))).otherwise(F.col("path"))
    shown = render(tracks.withColumn("current", relative), source)
    ext = F.regexp_extract("path", r"(?<=[^/])(\.[^./]+)$", 1)

    @F.pandas_udf("string")
    def fit(s: pd.Series, e: pd.Series) -> pd.Series:
        out = []
        for p, x in zip(s, e, strict=True):
            head, slash, last = (p or "").rpartition("/")
            out.append(head + slash + clamp(last, 255 - len(x.encode())) + x)
        return pd.Series(out)

    new = shown.withColumn("rendered", F.when(F.col("problem").isNull(), fit("rendered", ext)))
    rest = library.join(tracks.select("id"), "id", "left_anti").select("id", relative.alias("rendered"), F.lit(False).alias("in_batch"))
    clash = colliding(new.filter("problem is null").select("id", "rendered", F.lit(True).alias("in_batch")).unionByName(rest))
    hit = clash.select("id").distinct().withColumn("collides", F.lit(True))
    return new.select("id", "current", "rendered", "problem").join(hit, "id", "left").withColumn("collides", F.coalesce("collides", F.lit(False)))
