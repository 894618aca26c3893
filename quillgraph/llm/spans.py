"""Places of regular-expression matches in Spark SQL alone.

``regexp_extract_all`` gives the matches and ``split`` what lies between them; running
lengths (in code points) give the places.  Patterns use possessive repeats and look-behinds
so that neither depth nor time grows with the square of a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start, end (exclusive), kind and text of a match.
SPANS = "array<struct<s:int,e:int,k:string,t:string>>"
NO_SPANS = f"cast(array() as {SPANS})"


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, kind: str, pattern: str, where: str) -> str:
    """SQL: all leftmost non-overlapping matches in a column, as spans.

    ``where`` is a cheap condition without which there are none.
    """
    p = quoted(pattern)
    # a one-element array binds both parts to a name, so that each is worked out once
    return f"""if({where},
      aggregate(array(named_struct('gaps', split({text}, {p}, -1), 'found', regexp_extract_all({text}, {p}, 0))), {NO_SPANS}, (o, z) ->
        aggregate(z.gaps, named_struct('at', 0, 'i', 0, 'out', {NO_SPANS}), (a, g) -> named_struct(
          'at', a.at + length(g) + coalesce(length(get(z.found, a.i)), 0), 'i', a.i + 1,
          'out', if(a.i >= size(z.found), a.out, concat(a.out, array(named_struct(
            's', a.at + length(g), 'e', a.at + length(g) + length(get(z.found, a.i)), 'k', {quoted(kind)}, 't', get(z.found, a.i)))))
        )).out), {NO_SPANS})"""


def joined(spans: str, order: list[str]) -> Column:
    """kind:start:end by start, then kind as listed; comma-joined."""
    rank = " ".join(f"when {quoted(k)} then {i}" for i, k in enumerate(order))
    keyed = f"array_sort(transform({spans}, x -> named_struct('s', x.s, 'r', case x.k {rank} else 99 end, 'e', x.e, 'k', x.k)))"
    return F.expr(f"array_join(transform({keyed}, x -> concat(x.k, ':', x.s, ':', x.e)), ',')")
