"""Secret scans by a trigram inverted index, in DataFrame and SQL functions alone.

From each rule's regular expression a Boolean query over trigrams is derived: every match
must hold the trigrams of its literal parts, a choice those of one of its branches.  The
index holds postings (lists of documents) of the trigrams that some query names, in blocks
of documents, so that no posting list grows with the corpus.  In each block the queries'
lists are intersected and united; the documents that remain are candidates, and the rule's
expression verifies them.  A rule whose query is empty, as that for bare hexadecimal digits,
scans all texts.

Of a conjunction the rarest trigrams are kept.  Letters are compared without case in the
index.  Both may add candidates, never lose one.

Candidates go back to their texts by a broadcast join while they are few (``FEW_IDS``,
counted); beyond that by a shuffle join of the documents that hold any trigram of the index.

Defined cases: a null text is empty; rows of equal doc_id are candidates together and
verified one by one; rows without doc_id are verified for all rules; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import free, joined_by_id, named, saved
from quillgraph.llm.spans import joined, matches, quoted

BASE = ["assign", "access", "hex"]
#: Rules: kind, expression (Java, possessive where it must not retry), what a match must pass.
RULES = [
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+""", "assign"),
    ("access", r"AKIA[A-Z0-9]+", "length(x.t) >= 18"),
    ("hex", r"[0-9a-f]{16,}", "true"),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("google", r"AIza[A-Za-z0-9_-]{35}", "true"),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", "true"),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("url_password", r"://[A-Za-z0-9._-]{1,64}:[^ @/\t\n\r]{6,64}@", "true"),
]
KINDS = [k for k, *_ in RULES]
MARK = "[secret]"
FEW_IDS = 500_000
#: Documents in a block of the index, about.
BLOCK = 4096


# --- Boolean queries: True (anything), a trigram, or ("and" | "or", {queries})


def _all(parts) -> object:
    flat = set()
    for q in parts:
        if q is True:
            continue
        flat |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _any(parts) -> object:
    parts = set(parts)
    if True in parts or not parts:
        return True
    flat = set()
    for q in parts:
        flat |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _of(strings: set[str]) -> object:
    """What a text must hold if it holds one of the strings."""
    return _any(_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings)


def _letters(node) -> set[str] | None:
    """The few characters (in lower case) that a class stands for; None for more."""
    out: set[str] = set()
    for op, arg in node:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 4:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 5 else None


def _walk(nodes) -> tuple[object, set[str] | None]:
    """(query, the exact strings that the whole stands for, if few)."""
    queries, exact, only = [], {""}, True

    def cut() -> None:
        nonlocal exact, only
        queries.append(_of(exact))
        exact, only = {""}, False

    for op, arg in nodes:
        strings: set[str] | None = None
        query: object = True
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN:
            strings = _letters(arg)
        elif op is sre.SUBPATTERN:
            query, strings = _walk(arg[3])
        elif op is sre.BRANCH:
            found = [_walk(b) for b in arg[1]]
            query = _any(q for q, _ in found)
            if all(s is not None for _, s in found):
                strings = set().union(*(s for _, s in found))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, s = _walk(body)
            if s is not None and high == low and low <= 8:
                strings = {""}
                for _ in range(low):
                    strings = {a + b for a in strings for b in s}
            elif s is not None and (low, high) == (0, 1):
                strings = {""} | s
            query = inner if low else True
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if strings is not None and len(strings) * len(exact) <= 64:
            exact = {a + b for a in exact for b in strings}
        else:
            cut()
            if strings is not None:
                exact, only = strings, False
            else:
                queries.append(query)
    if not only:
        queries.append(_of(exact))
        return _all(queries), None
    return _of(exact), exact


def trigram_query(pattern: str) -> object:
    return _walk(parser.parse(pattern))[0]


def trigrams(q) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*(trigrams(x) for x in q[1]))


#: Fixed value: letters from frequent to rare, to tell which trigrams select best (quotes, which
#: may or may not follow a word, come last).
_FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"
#: Trigrams that a conjunction keeps.
MOST_TERMS = 2


def thin(q):
    """The query with the rarest trigrams of each conjunction only: weaker, so it loses nothing."""
    if not isinstance(q, tuple):
        return q
    parts = [thin(x) for x in q[1]]
    if q[0] == "or":
        return _any(parts)
    rare = sorted((x for x in parts if isinstance(x, str)), key=lambda t: (-sum(_FREQUENT.index(c) if c in _FREQUENT else -30 if c in "\"'" else 30 for c in t), t))
    return _all([x for x in parts if not isinstance(x, str)] + rare[:MOST_TERMS])


def _any_of(names: list[str]) -> str:
    """An expression for the trigrams that begin at a place, shared beginnings first."""
    tree: dict[str, dict[str, list[str]]] = {}
    for t in names:
        tree.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    esc = lambda c: c if c.isalnum() or c in "_/: " else "\\" + c
    group = lambda parts: parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return "|".join(esc(a) + group([esc(b) + group([esc(c) for c in cs]) for b, cs in bs.items()]) for a, bs in tree.items())


def _lists(q) -> str:
    """SQL over the block's map of postings ``m``: the documents that fit the query."""
    if isinstance(q, str):
        return f"coalesce(m[{quoted(q)}], cast(array() as array<bigint>))"
    parts = [_lists(x) for x in sorted(q[1], key=str)]
    out = parts[0]
    for p in parts[1:]:
        out = f"array_{'intersect' if q[0] == 'and' else 'union'}({out}, {p})"
    return out


def _indexed(rules: list[tuple[str, str, str]]) -> tuple[dict[int, object], str]:
    """The rules' queries, and SQL for the trigrams of a text that the index keeps (one pass)."""
    queries = {i: thin(q) for i, (_, p, _) in enumerate(rules) if (q := trigram_query(p)) is not True}
    names = sorted(set().union(*(trigrams(q) for q in queries.values()), set()))
    return queries, f"array_distinct(transform(regexp_extract_all(text, {quoted(f'(?i)(?=({_any_of(names)}))')}, 1), x -> lower(x)))"


def candidates(docs: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """doc_id, rules (numbers of the rules whose trigram query it fits), by the index."""
    # a document's trigrams that the index keeps, then postings by block
    queries, here = _indexed(rules)
    blocks = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.expr(here).alias("grams"))
    n = max(1, docs.count() // BLOCK)
    postings = rows.where("size(grams) > 0").select((blocks % n).alias("block"), "doc_id", F.explode("grams").alias("gram")).groupBy("block", "gram").agg(F.collect_set("doc_id").alias("docs"))
    index = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "docs"))).alias("m"))
    fits = ", ".join(f"named_struct('rule', {i}, 'docs', {_lists(q)})" for i, q in queries.items())
    hits = index.select(F.expr(f"inline(array({fits}))")).select("rule", F.explode("docs").alias("doc_id"))
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def _found(rules: list[tuple[str, str, str]], fits: str, text: str = "text") -> str:
    """SQL: the spans of all rules, each looked for where it may be (column ``fits``)."""
    out = []
    for i, (kind, pattern, test) in enumerate(rules):
        scan = trigram_query(pattern) is True
        where = f"{text} rlike {quoted(pattern)}" if scan else f"doc_id is null or coalesce(array_contains(`{fits}`, {i}), false)"
        spans = matches(text, kind, pattern, where)
        if test == "assign":
            # what follows the sign and one quote; shorter ones fail
            test = """length(regexp_extract(x.t, '^[A-Za-z_]+["\\']? *[:=] *["\\']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12"""
        out.append(spans if test == "true" else f"filter({spans}, x -> {test})")
    return "concat(" + ", ".join(out) + ")"


def _scanned(docs: DataFrame, few: int, spans: str = "spans") -> DataFrame:
    """The documents, null texts as empty ones, with a column of all spans."""
    fits = free("fitting_rules", [*docs.columns, spans])
    texts = docs.withColumn("text", F.coalesce("text", F.lit("")))
    found = saved(candidates(docs).withColumnRenamed("rules", fits), "secret-candidates")
    # documents without any trigram of the index are candidates for nothing
    return joined_by_id(texts, found, "left", few, F.expr(f"size({_indexed(RULES)[1]}) > 0")).withColumn(spans, F.expr(_found(RULES, fits))).drop(fits)


def _own(spans: str) -> str:
    """SQL: base spans, and those of other kinds that meet no base span."""
    kinds = ", ".join(map(quoted, BASE))
    return f"if(size({spans}) = 0, {spans}, filter({spans}, x -> x.k in ({kinds}) or not exists({spans}, b -> b.k in ({kinds}) and b.s < x.e and x.s < b.e)))"


def secrets(docs: DataFrame, few: int = FEW_IDS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added."""
    out = _scanned(docs.select("doc_id", "text"), few).select("doc_id", F.expr(_own("spans")).alias("found"))
    base = f"filter(found, x -> x.k in ({', '.join(map(quoted, BASE))}))"
    out = out.select("doc_id", "found", F.expr(base).alias("base"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(joined("base", BASE).cast("binary"), 256).alias("base_sha256"), joined("found", KINDS).alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_added"))


def masked(docs: DataFrame, few: int = FEW_IDS) -> DataFrame:
    """The documents, all columns, with each secret in text replaced by a mark; n_chars follows."""
    columns = docs.columns
    spans, null = free("secret_spans", columns), free("text_is_null", columns)
    found = _scanned(docs.withColumn(null, F.col("text").isNull()), few, spans)
    # spans by start; what an earlier one covers is not cut again
    cut = f"""aggregate(array_sort(transform(`{spans}`, x -> named_struct('s', x.s, 'e', x.e))), named_struct('at', 0, 'out', ''), (a, x) ->
        if(x.s < a.at, named_struct('at', greatest(a.at, x.e), 'out', a.out),
           named_struct('at', x.e, 'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), {quoted(MARK)}))),
        a -> concat(a.out, substring(text, a.at + 1)))"""
    found = found.withColumn("text", F.expr(f"if(`{null}`, cast(null as string), if(size(`{spans}`) = 0, text, {cut}))"))
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.expr(f"if(size(`{spans}`) = 0, n_chars, cast(length(text) as bigint))"))
    return found.select(*named(columns))
