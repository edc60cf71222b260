"""Rounding and number-to-text helpers.

Python's ``round`` is half-even; Spark's ``round`` is half-up, ``bround`` is
half-even (both on the shortest decimal form of the double).  ``round_even``
is used wherever the reference rounds.  Texts are built from the rounded
value so that ``%.nf`` formatting (half-up in the JVM) sees no tie.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_even(x, digits: int = 0) -> Column:
    return F.bround(_c(x), digits)


def fixed(x, digits: int) -> Column:
    """Text of x with a fixed number of decimals (Python ``f"{x:.nf}"``)."""
    return F.format_string(f"%.{digits}f", round_even(x, digits))


def py_float_text(x) -> Column:
    """Text of a double as Python's ``str(float)`` prints it for ordinary
    magnitudes (``12.0``, ``9.7``)."""
    return _c(x).cast("double").cast("string")


_FIELD = re.compile(r"\{(\w+)(?::\.(\d+)f)?\}")


def render(template: str, **values) -> Column:
    """A Python format string with named fields (``{x}`` or ``{x:.nf}``)
    as one Spark ``concat``: literal parts stay literals, ``{x:.nf}`` uses
    ``fixed`` and ``{x}`` the value's text."""
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = _c(values[m.group(1)])
        parts.append(fixed(v, int(m.group(2))) if m.group(2) else v.cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]
