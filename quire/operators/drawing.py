"""Drawing operators of content streams: tokens, what is passed on, kept strokes, forms."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry, values
from quire.staging import written

#: Operands of each operator that the interpreter knows; others are dropped.
OPERANDS: dict[str, int] = {
    **dict.fromkeys(("q", "Q", "h", "S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n", "W", "W*", "BT", "ET", "T*", "BI", "ID", "EMC", "SC", "sc", "SCN", "scn"), 0),
    **dict.fromkeys(("w", "J", "j", "M", "ri", "i", "gs", "CS", "cs", "G", "g", "Do", "Tc", "Tw", "Tz", "TL", "Tr", "Ts", "Tj", "TJ", "'", "MP", "BMC", "sh", "EI"), 1),
    **dict.fromkeys(("d", "m", "l", "Td", "TD", "Tf", "DP", "BDC"), 2),
    **dict.fromkeys(("RG", "rg", '"'), 3),
    **dict.fromkeys(("v", "y", "re", "K", "k"), 4),
    **dict.fromkeys(("c", "cm", "Tm"), 6),
}

_TOKEN = re.compile(rb"""%[^\r\n]*|(?P<string>\()|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<dict><<|>>)|(?P<array>[\[\]])|(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[\s()<>\[\]{}/%]|$))|(?P<word>[^\s()<>\[\]{}/%]+)""")


def _string_end(data: bytes, at: int) -> int:
    depth = 0
    while at < len(data):
        c = data[at]
        if c == 0x5C:
            at += 1
        elif c == 0x28:
            depth += 1
        elif c == 0x29:
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return len(data)


def tokens(data: bytes) -> Iterator[tuple[str, str]]:
    """(kind, text) of a content stream: operands and operator words, in order."""
    at = 0
    while match := _TOKEN.search(data, at):
        kind = match.lastgroup
        if kind == "string":
            at = _string_end(data, match.start())
            yield "string", data[match.start() : at].decode("latin-1")
            continue
        at = match.end()
        if kind:
            yield kind, match[0].decode("latin-1")
        if kind == "word" and match[0] == b"ID":  # an inline image's bytes, up to EI
            stop = re.compile(rb"\sEI(?=\s|$)").search(data, at)
            at = stop.end() if stop else len(data)
            yield "image", ""
            yield "word", "EI"


def operators(data: bytes, components: dict[str, int] | None = None) -> Iterator[tuple[str, list[str]]]:
    """(operator, operands) of a content stream.

    Colours take as many operands as their colour space has components: of a predefined
    space, or of ``components`` (name to number); one where none is set.
    """
    spaces = {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4, "Indexed": 1, "Separation": 1, "Pattern": 1} | (components or {})
    stack: list[str] = []
    depth: list[list[str]] = []
    size = {"S": 1, "n": 1}
    for kind, said in tokens(data):
        if kind in ("array", "dict") and said in ("[", "<<"):
            depth.append(stack)
            stack = []
        elif kind in ("array", "dict"):
            inner, stack = stack, (depth.pop() if depth else [])
            stack.append(("[" if said == "]" else "<<") + " ".join(inner) + said)
        elif kind != "word":
            stack.append(said)
        else:
            n = OPERANDS.get(said, len(stack))
            if said in ("CS", "cs") and stack:
                size["S" if said == "CS" else "n"] = spaces.get(stack[-1].lstrip("/"), 1)
            if said in ("SC", "SCN", "sc", "scn"):
                n = size["S" if said[0] == "S" else "n"]
            operands = stack[len(stack) - n :] if n else []
            stack = stack[: len(stack) - n] if n else stack
            yield said, operands


def written_operand(operand: str) -> str:
    """A real number with six decimals; whole numbers and names as they are, without quotes."""
    return f"{float(operand):f}" if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)", operand) else operand.replace("'", "")


def color_components(space: list | str, streams: dict | None = None) -> int | None:
    """Components of a colour space: of an embedded profile, of a list of inks, or predefined."""
    name = space[0] if isinstance(space, list) else space
    if name == "ICCBased" and isinstance(space, list) and len(space) > 1:
        return int(space[1]["N"])
    if name == "DeviceN" and isinstance(space, list) and len(space) > 1:
        return len(space[1])
    return {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4, "Indexed": 1, "Separation": 1, "Pattern": 1}.get(name)


def passed_on(op: Column, nargs: Column) -> Column:
    """Whether an operator stays in the page's base stream."""
    known = op.isin(*OPERANDS)
    dropped = op.startswith("T") | op.isin(*values.DROPPED_WITH_OPERANDS) | op.isin(*values.DROPPED_WITHOUT_OPERANDS)
    return known & ~dropped & (nargs >= F.lit(0))


def base_stream(ops: DataFrame, key: tuple[str, ...] = ("doc_id", "obj_id")) -> DataFrame:
    """What is passed on of each object, in order, as one text.

    ``ops`` has the key, seq, op, args (texts, already as written) and nargs; a stroke that
    layout keeps (``kept``) leaves its path to be ended without painting.
    """
    said = F.concat(F.array_join("args", " "), F.lit(" "), F.col("op"), F.lit(" "))
    kept = ops.where(passed_on(F.col("op"), F.col("nargs"))).withColumn("said", F.when(F.col("kept"), F.lit("n S ")).otherwise(said))
    return kept.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "said"))), lambda x: x["said"]), "").alias("ops"))


def black(color: Column) -> Column:
    """Components that sum to nothing."""
    return F.aggregate(color, F.lit(0.0), lambda a, x: a + x) == 0


def layout_stroke(path: Column, ctm: Column, color: Column) -> Column:
    """A black level line by itself: moved to, drawn to, level under the matrix.

    ``path``: array of structs op, x, y.
    """
    a, b = F.try_element_at(path, F.lit(1)), F.try_element_at(path, F.lit(2))
    level = geometry.apply(ctm, a["x"], a["y"])["y"] == geometry.apply(ctm, b["x"], b["y"])["y"]
    return F.coalesce((F.size(path) == 2) & (a["op"] == "m") & (b["op"] == "l") & level & black(color), F.lit(False))


def thin(lines: DataFrame, width: str = "linewidth") -> DataFrame:
    """Lines that are drawn again; thicker ones often stand in for pictures."""
    return lines.where(F.col(width) < values.THICK_LINE)


def form_tree(forms: DataFrame, roots: DataFrame) -> DataFrame:
    """Every form reachable from a page: (doc_id, page, form, depth, matrix), cycles cut.

    ``forms``: doc_id, parent, form, matrix; ``roots``: doc_id, page, form, matrix. Matrices
    multiply down the tree. A join for each level, until none adds a row, however deep; each
    level is written, so that plans do not grow and no level is computed twice.
    """
    level, _ = written(roots.select("doc_id", "page", "form", F.lit(0).alias("depth"), "matrix", F.array("form").alias("path")), "forms")
    child = forms.select(F.col("doc_id").alias("d"), "parent", F.col("form").alias("child"), F.col("matrix").alias("m"))
    out, depth = level, 0
    while level.limit(1).count():
        depth += 1
        level, _ = written(
            level.join(child, (F.col("doc_id") == F.col("d")) & (F.col("form") == F.col("parent")))
            .where(~F.array_contains("path", F.col("child")))
            .select("doc_id", "page", F.col("child").alias("form"), F.lit(depth).alias("depth"), geometry.product(F.col("m"), F.col("matrix")).alias("matrix"), F.concat("path", F.array("child")).alias("path")),
            "forms",
        )
        out = out.unionByName(level)
    return out.drop("path")


def page_patch(base: Column, x0: Column, y0: Column, new: Column) -> Column:
    """A page's new stream: the base, then the new text moved back by the crop box."""
    n = lambda c: c.cast("string")
    return F.concat(F.lit("q "), F.coalesce(base, F.lit("")), F.lit("Q 1 0 0 1 "), n(x0), F.lit(" "), n(y0), F.lit(" cm "), new)


def form_patch(base: Column, ctm: Column, new: Column) -> Column:
    """A form's new stream, its matrix undone before the new text; null if it cannot be."""
    inv = geometry.inverse(ctm)
    return F.concat(F.lit("q "), F.coalesce(base, F.lit("")), F.lit("Q "), F.array_join(F.transform(inv, lambda x: x.cast("string")), " "), F.lit(" cm "), new)
