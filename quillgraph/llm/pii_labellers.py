"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Candidates are spans that loose patterns find.  Labellers vote on each candidate: its shape
and borders, its check digits, a gazetteer around it, words of its context, and how varied it
is.  The votes are counted by kind and pattern; expectation-maximisation on the counts (one
row a kind, all in SQL) estimates the labellers' reliabilities and the probability of each
pattern, and these soft labels train a logistic span classifier, also in SQL.  What it
accepts is added to the base spans, which stay whatever the votes.

The counts have at most kinds x 3**labellers rows and the classifier one row a kind, so what
goes to the driver has a bound that does not depend on the input.

Defined cases: a null text is empty and has no spans; rows of equal doc_id are searched one
by one; columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import saved
from quillgraph.llm.spans import joined, matches, quoted

BASE = ["email", "ip", "card", "phone"]
EXTRA = ["ssn", "iban", "national_phone", "spelt_email", "person"]
#: Patterns and the cheap conditions before them.  Possessive forms of the base patterns.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "text rlike '[0-9][.][0-9]'"),
    "card": (r"[0-9](?:[ -]?[0-9]){13,}+", "text rlike '[0-9](?:[ -]?[0-9]){13}'"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "contains(text, '+')"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "digits and contains(text, '-')"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "digits"),
    "national_phone": (r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "digits"),
    "spelt_email": (r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}+ ?[(\[]at[)\]] ?[a-z0-9-]{1,63}+(?: ?(?:\.|[(\[]dot[)\]]) ?[a-z0-9-]{1,63}+)+", "contains(lower(text), 'at)') or contains(lower(text), 'at]')"),
    "person": (r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}{1,30}+(?: \p{Lu}\p{Ll}{1,30}+)?", "titles"),
}
#: Endings, names and context words that speak for a kind.
GAZETTEER = r"(?i)(?:\.(?:com|net|org|edu|gov|io|de|fr|es|uk|eu|info)$|\b(?:anna|maria|peter|john|james|mary|michael|thomas|jean|pierre|marie|jose|juan|carlos|carmen|hans|klaus|sophie)\b)"
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse|dirección",
    "card": "card|visa|master|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf|llam|appel",
    "ssn": "ssn|social|security",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "national_phone": "phone|call|tel|mobile|fax",
    "spelt_email": "mail|contact|write|kontakt|correo|courriel",
    "person": "dear|hello|name|sincerely|liebe|chère|cher|hola",
}
LABELLERS = 5
STEPS = 25
THRESHOLD = 0.5


def _valid(x: str) -> str:
    """SQL: may this base match stay?"""
    octet = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)"
    digits = f"regexp_replace({x}.t, '[^0-9]', '')"
    return f"""case {x}.k
      when 'ip' then {x}.t rlike {quoted(f'^{octet}(?:[.]{octet}){{3}}$')}
      when 'card' then length({digits}) between 14 and 19 and luhn_check({digits})
      when 'phone' then length({digits}) between 10 and 15
      else true end"""


def _checks(x: str) -> str:
    """SQL: does the candidate pass what its kind can be checked by?  2, 0, or 1 for neither."""
    digits = f"regexp_replace({x}.t, '[^0-9]', '')"
    test = f"""case {x}.k
      when 'email' then {x}.t rlike '[A-Za-z]$'
      when 'ip' then not ({x}.t rlike '^(?:0|127|255)[.]')
      when 'card' then luhn_check({digits})
      when 'phone' then length({digits}) between 10 and 15
      when 'ssn' then not ({x}.t rlike '^(?:000|666|9)|-00-|-0000$')
      when 'iban' then length(replace({x}.t, ' ', '')) between 15 and 34
      when 'national_phone' then {digits} rlike '^[2-9]..[2-9]'
      when 'spelt_email' then {x}.t rlike '[A-Za-z]{{2}}$' end"""
    return f"coalesce(if({test}, 2, 0), 1)"


def _votes(x: str, text: str) -> str:
    """SQL: array of votes, 0 against, 1 nothing, 2 for."""
    before = f"substring({text}, greatest({x}.s - 39, 1), least({x}.s, 40))"
    near = f"substring({text}, greatest({x}.s - 29, 1), {x}.e - {x}.s + 60)"
    after = f"substring({text}, {x}.e + 1, 1)"
    context = "case " + x + ".k " + " ".join(f"when {quoted(k)} then lower({before}) rlike {quoted(v)}" for k, v in CONTEXT.items()) + " end"
    kinds = f"length({x}.t) - length(regexp_replace({x}.t, '(.)(?=\\\\1)', ''))"
    return f"""array(
      if({before} rlike '[A-Za-z0-9]$' or {after} rlike '[A-Za-z0-9]', 0, 2),
      {_checks(x)},
      if({x}.t rlike {quoted(GAZETTEER)} or {near} rlike {quoted(GAZETTEER)}, 2, 1),
      if({context}, 2, 1),
      case when {kinds} >= length({x}.t) * 0.4 then 0 when {kinds} <= 2 then 2 else 1 end)"""


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans that stay), extra (candidates: span and votes of further ones), seen."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = found.withColumn("digits", F.expr("text rlike '[0-9]{2}'")).withColumn("titles", F.expr(r"text rlike '(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)[.]? \\p{Lu}'"))
    base = ", ".join(matches("text", k, *PATTERNS[k]) for k in BASE)
    extra = ", ".join(matches("text", k, *PATTERNS[k]) for k in EXTRA)
    found = found.select("doc_id", "text", F.expr(f"concat({base})").alias("all_base"), F.expr(f"concat({extra})").alias("all_extra"))
    found = found.select("doc_id", "text", F.expr(f"if(size(all_base) = 0, all_base, filter(all_base, x -> {_valid('x')}))").alias("base"), "all_extra")
    free = "if(size(all_extra) = 0, all_extra, filter(all_extra, x -> not exists(base, b -> b.s < x.e and x.s < b.e)))"
    voted = lambda c: f"transform({c}, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'v', {_votes('x', 'text')}))"
    return found.select("doc_id", F.expr(voted("base")).alias("base"), F.expr(voted(free)).alias("extra"))


def _posterior(t: str, x: str) -> str:
    """SQL: probability that candidates of pattern x are right, under the parameters t."""
    part = lambda side: f"aggregate(sequence(0, {LABELLERS - 1}), 0D, (s, j) -> s + ln(get(get({t}.{side}, j), get({x}.v, j))))"
    return f"(1D / (1D + exp(greatest(-40D, least(40D, ln(1D - {t}.prior) - ln({t}.prior) + {part('no')} - {part('yes')})))))"


def reliabilities(voted: DataFrame) -> DataFrame:
    """Of candidates (k, v): by kind, the EM parameters and the trained classifier's weights.

    k, prior, yes and no (per labeller: probabilities of the votes 0, 1, 2), weights.
    """
    counts = voted.groupBy("k", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = counts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("p"))
    yes, no = "array(0.15D, 0.3D, 0.55D)", "array(0.5D, 0.35D, 0.15D)"
    start = f"named_struct('prior', 0.5D, 'yes', array_repeat({yes}, {LABELLERS}), 'no', array_repeat({no}, {LABELLERS}))"

    def side(first: str, weight: str) -> str:
        hit = f"aggregate(r, 0D, (s, y) -> s + if(get(y.v, j) = u, {weight}, 0D))"
        total = f"aggregate(r, 0D, (s, y) -> s + {weight})"
        # a few votes of the first guess keep rare patterns in bounds
        return f"transform(sequence(0, {LABELLERS - 1}), j -> transform(sequence(0, 2), u -> (4D * get({first}, u) + {hit}) / (4D + {total})))"

    step = f"""(t, i) -> aggregate(array(transform(p, x -> named_struct('v', x.v, 'n', x.n, 'q', {_posterior('t', 'x')}))), t, (o, r) -> named_struct(
        'prior', (2D + aggregate(r, 0D, (s, y) -> s + y.n * y.q)) / (4D + aggregate(r, 0D, (s, y) -> s + y.n)),
        'yes', {side(yes, 'y.n * y.q')}, 'no', {side(no, 'y.n * (1D - y.q)')}))"""
    fitted = rows.select("k", "p", F.expr(f"aggregate(sequence(1, {STEPS}), {start}, {step})").alias("t"))
    soft = fitted.select("k", "t", F.expr(f"transform(p, x -> named_struct('v', x.v, 'n', x.n, 'q', {_posterior('t', 'x')}))").alias("p"))
    # the classifier sees a bias and the votes as -1, 0, 1; gradient steps on the soft labels
    zeros = f"array_repeat(0D, {LABELLERS + 1})"
    f = "if(j = 0, 1D, get(y.v, j - 1) - 1D)"
    error = f"y.n * (y.q - {_logistic('w', 'y.v')})"
    gradient = f"aggregate(p, 0D, (s, y) -> s + {error} * {f}) / aggregate(p, 1D, (s, y) -> s + y.n)"
    trained = f"aggregate(sequence(1, 60), {zeros}, (w, i) -> transform(sequence(0, {LABELLERS}), j -> get(w, j) + 2D * ({gradient}) - 0.002D * get(w, j)))"
    return soft.select("k", "t.prior", "t.yes", "t.no", F.expr(trained).alias("weights"))


def _logistic(w: str, v: str) -> str:
    return f"(1D / (1D + exp(-(get({w}, 0) + aggregate(sequence(1, {LABELLERS}), 0D, (z, m) -> z + get({w}, m) * (get({v}, m - 1) - 1D))))))"


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    found = saved(candidates(docs), "pii-candidates")
    voted = found.select(F.expr("explode(concat(base, extra))").alias("x")).select("x.k", "x.v")
    # one row a kind
    weights = {r.k: r.weights for r in reliabilities(voted).select("k", "weights").collect()}
    accept = "false"
    if weights:
        cases = " ".join(f"when {quoted(k)} then array({', '.join(f'{x!r}D' for x in w)})" for k, w in sorted(weights.items()))
        accept = f"{_logistic(f'case x.k {cases} end', 'x.v')} >= {threshold!r}D"
    plain = "transform({}, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 't', ''))"
    out = found.select("doc_id", F.expr(plain.format("base")).alias("base"), F.expr(plain.format(f"if(size(extra) = 0, extra, filter(extra, x -> {accept}))")).alias("added"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(joined("base", BASE).cast("binary"), 256).alias("base_sha256"), joined("concat(base, added)", BASE + EXTRA).alias("spans"), F.size("added").cast("long").alias("n_added"))
