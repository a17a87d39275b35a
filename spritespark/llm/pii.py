r"""Personal data: high-recall generators propose overlapping spans, boosted trees select the ones to redact.

Base spans follow fixed rules for e-mail, ip, card and phone, leftmost and non-overlapping for each kind; matches that
fail their check (octets, Luhn, digit counts) are dropped without a retry. Generators then propose shorter or looser
spans (a card inside a longer run of digits, a phone without a plus, an address spelt with "at" and "dot"). Gradient
boosted trees score each from its format and context; a threshold for each kind selects those that are added where no
base span lies, the better one where two overlap. Base spans always stay.

No label comes from the rules: spans of known families (PLANTS), personal or only alike, are planted between pieces of
the corpus's own texts, and a proposal is positive when it is a planted personal span. The trees learn from plants in a
bounded sample of texts (small tables give several plants a text); thresholds are calibrated for PRECISION on a plant in
every text that was not learnt from. The trees are then written as SQL CASE expressions, so that all texts are scored in
the row that holds them: built-in functions only, and no shuffle.

The patterns are rewritten so that Java's matcher neither recurses nor backtracks over long runs: possessive loops, and
starts that are tied to the start of a run (or to the end of the last match). They match the same spans. What is carried
from match to match goes through arrays in blocks, so that a text of very many matches takes little more than linear time.

Defined cases: a null text counts as empty (and stays null when redacted), an empty text has no spans; a null doc_id
is kept; every row is treated by itself, so repeated rows repeat; an empty table gives no rows; extra columns, whatever
their names, pass through ``redact`` and are not read.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spritespark.llm.common import fresh, stored, table

KINDS = ("email", "ip", "card", "phone")
#: Base patterns by kind, and a cheap one that a text must hold first.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9][0-9\x20-]{11,}[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
#: Generators: kind, pattern.
PROPOSED = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20\.\x20?|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?)[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]{1,3}+\.[0-9]{1,3}+\.[0-9]{1,3}+\.[0-9]{1,3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?+\(?[0-9]{3}\)?[\x20.-]?+[0-9]{3}[\x20.-]?+[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9.-])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
)
#: What a text must hold for any proposal.
_ANY = r"[0-9][0-9.\x20()-]{5,}[0-9]|@|[\[(]at[\])]"
#: About so many texts have plants to learn from, and small tables so many plants in all.
SAMPLE, PLANTED = 20_000, 12_000
PRECISION = 0.95
#: Elements of a block of an array.
BLOCK = 512
#: Families of planted spans: kind, whether personal, SQL that gives one. N: digits, W: a word, L: digits with a right check digit.
PLANTS = (
    ("email", 1, "concat(W1, ' [at] ', W2, ' [dot] com')"), ("email", 1, "concat(W1, '(at)', W2, '(dot)org')"), ("email", 1, "concat(W1, ' @ ', W2, ' . net')"), ("email", 1, "concat(W1, '.', W3, ' (at) ', W2, '.co')"), ("email", 1, "concat(W1, '@', W2, '.com')"), ("email", 1, "concat(W1, N1_2, ' [at] ', W2, ' [dot] org')"), ("email", 1, "concat(W1, N1_1, '(at)', W2, N2_1, '.net')"),
    ("email", 0, "concat(N1_1, ' @ ', N2_1, '.', N3_2)"), ("email", 0, "concat(W1, ' @ ', W2, '. Then')"), ("email", 0, "concat(W1, ' @ ', N2_1, '.', N3_2)"), ("email", 0, "concat(N1_2, ' [at] ', N2_2, '.', N3_1)"),
    ("phone", 1, "concat('(', P1, ') ', P2, '-', N3_4)"), ("phone", 1, "concat(P1, '-', P2, '-', N3_4)"), ("phone", 1, "concat(P1, '.', P2, '.', N3_4)"), ("phone", 1, "concat('+1 ', P1, ' ', P2, ' ', N3_4)"), ("phone", 1, "concat('tel. (', P1, ')', P2, '-', N3_4)"),
    ("phone", 0, "concat('(1', N1_2, ') 0', N2_2, '-', N3_4)"), ("phone", 0, "concat('00', N1_1, '-1', N2_2, '-', N3_4)"), ("phone", 0, "concat('1', N1_2, '.0', N2_2, '.', N3_4)"), ("phone", 0, "concat('order no. ', P1, '-', P2, '-', N3_4)"), ("phone", 0, "concat('isbn ', P1, '-', P2, '-', N3_4)"),
    ("card", 1, "L"), ("card", 1, "concat('visa ', N1_2, ' ', L)"), ("card", 0, "concat('serial ', N1_4, N2_4, N3_4, N1_3, N2_1)"), ("card", 0, "concat('id ', N1_4, N2_4, N3_4, N2_2)"), ("card", 0, "concat(N1_4, '-', N2_4, '-', N3_4, '-', N1_2, N3_2)"),
    ("ip", 1, "concat('1', N1_2, '.', N2_1, '.', N3_2, '.1')"), ("ip", 0, "concat('3', N1_2, '.', N2_1, '.', N3_2, '.9')"), ("ip", 0, "concat(N1_1, '.', N2_1, '.7', N3_2, '.', N1_2)"),
)


def _q(pattern: str) -> str:
    return "r'" + pattern + "'"


def _scan(array: str, state: str, step: str, out: str, kind: str) -> str:
    """SQL: array of ``out`` for each element x of an array, and a state st that ``step`` carries on.

    Blocks keep what each append copies short: n elements cost n * BLOCK / 2 + (n / BLOCK)^2 / 2 copied references.
    """
    inner = f"aggregate(slice(a, i * {BLOCK} + 1, {BLOCK}), named_struct('st', acc.st, 'out', cast(array() AS array<{kind}>)), (q, x) -> named_struct('st', {step.replace('st.', 'q.st.')}, 'out', array_append(q.out, {out.replace('st.', 'q.st.')})))"
    return f"""element_at(transform(array({array}), a -> aggregate(sequence(0, greatest(0, (size(a) - 1) div {BLOCK})), named_struct('st', {state}, 'outs', cast(array() AS array<array<{kind}>>)),
      (acc, i) -> element_at(transform(array({inner}), r -> named_struct('st', r.st, 'outs', array_append(acc.outs, r.out))), 1), acc -> flatten(acc.outs))), 1)"""


_MATCH = "struct<s:int,e:int,m:string,before:string,after:string>"


def _found(text: str, pattern: str, first: str) -> str:
    """SQL: array of (s, e, m, before, after) of a pattern's matches, in code points: what lies between matches gives the places.

    before: the end of what lies before a match, after: the start of what follows, each up to the match beyond it."""
    each = """zip_with(sequence(0, size(ms) - 1), ms, (i, m) -> named_struct('m', m, 'g', gs[i],
        'before', right(concat(CASE WHEN i > 0 THEN right(ms[i - 1], 20) ELSE '' END, right(gs[i], 20)), 20), 'after', left(concat(left(gs[i + 1], 8), CASE WHEN i + 1 < size(ms) THEN left(ms[i + 1], 8) ELSE '' END), 8)))"""
    none = f"cast(array() AS array<{_MATCH}>)"
    scan = _scan(each, "named_struct('at', 0)", "named_struct('at', st.at + char_length(x.g) + char_length(x.m))", "named_struct('s', st.at + char_length(x.g), 'e', st.at + char_length(x.g) + char_length(x.m), 'm', x.m, 'before', x.before, 'after', x.after)", _MATCH)
    return f"""CASE WHEN {text} RLIKE {_q(first)} THEN element_at(transform(array(named_struct('ms', regexp_extract_all({text}, {_q(pattern)}, 0), 'gs', split({text}, {_q(pattern)}, -1))),
      y -> CASE WHEN size(y.ms) = 0 THEN {none} ELSE {scan.replace("size(ms)", "size(y.ms)").replace(" ms,", " y.ms,").replace("ms[i", "y.ms[i").replace("gs[i", "y.gs[i")} END), 1) ELSE {none} END"""


_DIGITS = "regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    d = _DIGITS.format(m=m)
    return f"(aggregate(sequence(1, char_length({d})), 0, (acc, i) -> acc + CASE WHEN i % 2 = 1 THEN int(substr(reverse({d}), i, 1)) ELSE int(element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), 1 + int(substr(reverse({d}), i, 1)))) END) % 10 = 0)"


def _octets(m: str) -> str:
    """The largest of the four parts; more than four digits after leading zeros count as 9999."""
    return f"array_max(transform(split({m}, '[.]'), o -> CASE WHEN char_length(ltrim('0', o)) > 4 THEN 9999 ELSE int(concat('0', ltrim('0', o))) END))"


def _valid(kind: str, m: str) -> str:
    d = f"char_length({_DIGITS.format(m=m)})"
    return {
        "email": f"({m} RLIKE {_q('^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++$')})",
        "ip": f"({_octets(m)} <= 255)",
        "card": f"({d} BETWEEN 13 AND 19 AND CASE WHEN {d} BETWEEN 13 AND 19 THEN {_luhn(m)} ELSE false END)",
        "phone": f"(startswith({m}, '+') AND {d} BETWEEN 9 AND 15)",
    }[kind]


_LOCAL = r"^[^@(\[\x20]*[A-Za-z]"  # a letter before the sign
_SENTENCE = r"[^\x20]\.\x20"  # a dot that ends a sentence rather than stands between spaces


def with_base(documents: DataFrame, text: str, name: str) -> DataFrame:
    """documents with the column ``name``: array of (k, s, e), by kind, then start. k: place in KINDS."""
    own = f"coalesce(`{text}`, '')"
    kept = [f"transform(filter({_found(own, *BASE[kind])}, x -> {_valid(kind, 'x.m')}), x -> named_struct('k', {k}, 's', x.s, 'e', x.e))" for k, kind in enumerate(KINDS)]
    return documents.withColumn(name, F.expr(f"concat({', '.join(kept)})"))


_PROPOSAL = "struct<k:int,s:int,e:int,m:string,before:string,after:string>"


def _proposals(text: str, base: str) -> str:
    """SQL: array of the proposals of a text that overlap none of its base spans.

    Both are put in one order by start; on the way through it, and back, the spans met so far tell which are clear.
    """
    none = f"cast(array() AS array<{_PROPOSAL}>)"
    found = ", ".join(f"transform({_found(text, pattern, '[0-9@]|at')}, x -> named_struct('k', {KINDS.index(kind)}, 's', x.s, 'e', x.e, 'm', x.m, 'before', x.before, 'after', x.after))" for kind, pattern in PROPOSED)
    # only numbers go through the scans: each step copies what its block holds so far
    events = f"array_sort(concat(transform(p, (x, i) -> named_struct('s', x.s, 't', 1, 'e', x.e, 'i', i)), transform({base}, x -> named_struct('s', x.s, 't', 0, 'e', x.e, 'i', -1))))"
    forth = _scan("v", "named_struct('to', 0)", "named_struct('to', CASE WHEN x.t = 0 THEN greatest(st.to, x.e) ELSE st.to END)", "x.s < st.to", "boolean")
    back = _scan("reverse(v)", "named_struct('from', 2147483647)", "named_struct('from', CASE WHEN x.t = 0 THEN least(st.from, x.s) ELSE st.from END)", "st.from < x.e", "boolean")
    hit = f"zip_with({forth}, reverse({back}), (a, b) -> a OR b)"
    clear = f"element_at(transform(array({events}), v -> transform(filter(zip_with(v, {hit}, (x, h) -> CASE WHEN x.t = 1 AND NOT h THEN x.i END), i -> i IS NOT NULL), i -> p[i])), 1)"
    return f"CASE WHEN {text} RLIKE {_q(_ANY)} THEN element_at(transform(array(concat({found})), p -> CASE WHEN size(p) = 0 THEN {none} WHEN size({base}) = 0 THEN p ELSE {clear} END), 1) ELSE {none} END"


def _features(x: str) -> str:
    """SQL: the array of doubles of a proposal's format and context."""
    m, d = f"{x}.m", _DIGITS.format(m=f"{x}.m")
    side = lambda c: f"CASE WHEN {c} = '' THEN 0 WHEN {c} RLIKE '[0-9]' THEN 3 WHEN {c} RLIKE '[A-Za-z_]' THEN 2 WHEN {c} RLIKE '[ \\\\n\\\\t]' THEN 1 ELSE 4 END"
    each = (
        f"{x}.k", f"char_length({m})", f"char_length({d})", f"char_length({m}) - char_length({d})", f"int(startswith({m}, '+'))", side(f"right({x}.before, 1)"), side(f"left({x}.after, 1)"),
        f"CASE WHEN {x}.k = 2 THEN int({_luhn(m)}) ELSE -1 END", f"CASE WHEN {x}.k = 1 THEN {_octets(m)} ELSE -1 END", f"CASE WHEN {x}.k = 0 THEN -1 ELSE size(array_distinct(split({d}, ''))) END", f"int({m} RLIKE '[(]')",
        f"int({x}.before RLIKE '(?i)(card|visa|phone|tel|call|mail|contact|addr|host|server)')", f"CASE WHEN {x}.k = 0 OR {d} = '' THEN -1 ELSE int(left({d}, 1)) END", f"int({m} RLIKE '[\\\\[(](at|dot)[\\\\])]')", f"int({x}.before RLIKE '[0-9][ .-]$')", f"int({x}.after RLIKE '^[ .-][0-9]')",
        f"int({m} RLIKE {_q(_SENTENCE)})", f"int({m} RLIKE {_q('[.)\\] ][A-Za-z]{2,24}$')})", f"CASE WHEN {x}.k = 0 OR char_length({d}) < 4 THEN -1 ELSE int(substr({d}, 4, 1)) END", f"int({x}.before RLIKE {_q('(?i)(phone|tel|call|fax|mobile|cell|contact|reach|text)')})", f"int({x}.after RLIKE {_q('^[.-]?[0-9]')})", f"int({m} RLIKE {_q(_LOCAL)})", f"int({x}.before RLIKE {_q('(?i)(order|isbn|serial|part|no[.]|id|ref|version)')})",
    )
    return "array(" + ", ".join(f"cast({e} AS double)" for e in each) + ")"


def _tree(node, f: str = "f") -> str:
    """A regression tree's node as SQL over the array f."""
    if node.subtreeDepth() == 0:
        return repr(float(node.prediction()))
    split = node.split()
    return f"CASE WHEN {f}[{split.featureIndex()}] <= {float(split.threshold())!r}D THEN {_tree(node.leftChild(), f)} ELSE {_tree(node.rightChild(), f)} END"


class Selector:
    """score: SQL over the feature array f (0 to 1); thresholds by kind. None adds nothing."""

    def __init__(self, score: str | None, thresholds: dict[int, float]):
        self.score, self.thresholds = score, thresholds


def planted(texts: DataFrame, families: str) -> DataFrame:
    """(k, label, f, u, h) of all proposals around planted spans. texts: text, u (a hash), v (a number for each plant of a
    text); families: SQL, the array of families to plant. label: 1.0 for a planted personal span itself."""
    value = lambda n: f"pmod(xxhash64(u, v, t, {n}), 1000000007)"
    digits = {f"N{i}_{n}": f"lpad(pmod({value(i)}, {10**n}), {n}, '0')" for i in (1, 2, 3) for n in (1, 2, 3, 4)}
    words = {f"W{i}": f"right(translate(conv({value(20 + i)} + 600000000, 10, 20), '0123456789', 'klmnopqrst'), 2 + pmod({value(60 + i)}, 6))" for i in (1, 2, 3)}
    areas = {f"P{i}": f"concat(2 + pmod({value(30 + i)}, 8), lpad(pmod({value(40 + i)}, 100), 2, '0'))" for i in (1, 2)}
    areas["P2"] = f"concat(2 + pmod({value(32)}, 8), lpad(pmod({value(42)}, 100), 2, '0'))"
    body = f"concat('4', lpad({value(50)}, 14, '7'))"
    doubled = "aggregate(sequence(1, 15), 0, (acc, i) -> acc + CASE WHEN i % 2 = 0 THEN int(substr(b, i, 1)) ELSE int(element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), 1 + int(substr(b, i, 1)))) END)"
    names = digits | words | areas | {"L": f"element_at(transform(array({body}), b -> concat(b, pmod(10 - {doubled} % 10, 10))), 1)"}

    def made(sql: str) -> str:
        return re.sub(r"\b(N[1-3]_[1-4]|W[1-3]|P[12]|L)\b", lambda m: f"({names[m[0]]})", sql)

    span = "CASE " + " ".join(f"WHEN t = {i} THEN {made(sql)}" for i, (_, _, sql) in enumerate(PLANTS)) + " END"
    good = ", ".join(str(x) for _, x, _ in PLANTS)
    each = texts.select("text", "u", "v", F.explode(F.expr(families)).alias("t"))
    each = each.withColumn("at", F.expr("pmod(xxhash64(u, v, t), greatest(1, char_length(text) - 24))").cast("int"))
    each = each.select("u", "v", "t", F.expr(span).alias("span"), F.expr("substring(text, at + 1, 24)").alias("left"), F.expr("substring(text, at + 25, 16)").alias("right"))
    each = each.select("u", "t", "span", F.expr("concat(left, ' ')").alias("left"), F.expr("concat(left, ' ', span, ' ', right)").alias("text"))
    own = ", ".join(str(KINDS.index(k)) for k, _, _ in PLANTS)
    # explode_outer: explode would add a filter that finds all proposals again
    rows = each.withColumn("none", F.expr("cast(array() AS array<struct<k:int,s:int,e:int>>)")).select("u", "t", "span", "left", F.explode_outer(F.expr(_proposals("text", "none"))).alias("x")).filter("x IS NOT NULL")
    # what begins in the text before a plant is nobody's: real personal data may lie there
    inside = "x.s BETWEEN char_length(left) AND char_length(left) + char_length(span) - 1"
    # the whole plant, or all of it but the word before the number
    whole = "x.e = char_length(left) + char_length(span) AND (x.s = char_length(left) OR substring(span, 1, x.s - char_length(left)) IN ('tel. ', 'visa ') OR span LIKE 'visa%' AND x.s = char_length(left) + 8)"
    found = rows.filter(inside).withColumn("own", F.expr(f"element_at(array({own}), t + 1) = x.k")).withColumn("good", F.expr(f"element_at(array({good}), t + 1) = 1"))
    # other parts of a planted personal span are neither right nor wrong
    return found.withColumn("label", F.expr(f"good AND own AND {whole}").cast("double")).filter("label = 1 OR NOT good OR NOT own").select("u", F.col("x.k").alias("k"), "label", F.expr(_features("x")).alias("f"))


def train_selector(documents: DataFrame, sample: int = SAMPLE, trees: int = 16, depth: int = 4) -> Selector:
    """Fits the trees on plants in about ``sample`` texts, chosen by a hash of the text, and calibrates on one in every other text."""
    n = documents.count()
    if not n:
        return Selector(None, {})
    share = min(0.5, sample / n)
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("u", F.xxhash64("text"))
    texts = texts.withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(-(-PLANTED // n)))))
    learn = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)) < int(share * (1 << 30))
    one = f"array(int(pmod(xxhash64(u, v, 7), {len(PLANTS)})))"
    rows = stored(planted(texts.filter(learn), one).dropDuplicates(["u", "k", "label", "f"]), "plants")
    if rows.select("label").distinct().count() < 2:
        return Selector(None, {})
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5, cacheNodeIds=False).fit(rows.select("label", array_to_vector("f").alias("v")))
    java = model._java_obj
    margin = " + ".join(f"{float(w)!r}D * ({_tree(t.rootNode())})" for t, w in zip(java.trees(), java.treeWeights(), strict=True))
    score = f"1 / (1 + exp(-2 * ({margin})))"
    bins = planted(texts.filter(~learn), one).withColumn("s", F.floor(F.expr(score) * 100)).groupBy("k", "s").agg(F.sum("label").alias("good"), F.count("*").alias("all")).collect()  # 101 rows a kind
    thresholds = {}
    for k in range(len(KINDS)):
        good = total = 0
        own = sorted((r for r in bins if r.k == k), key=lambda r: -r.s)
        for r, below in zip(own, [*(r.s for r in own[1:]), 0], strict=True):
            good, total = good + r.good, total + r["all"]
            if r.s >= 50 and good >= PRECISION * total:  # all above the next score met
                thresholds[k] = max(0.5, (below + 1) / 100)
    return Selector(score, thresholds)


def with_spans(documents: DataFrame, selector: Selector, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """documents with two columns, arrays of (k, s, e), by kind, then start: the base spans, and these and the added ones."""
    out = with_base(documents, text, base)
    if not selector.score or not selector.thresholds:
        return out.withColumn(spans, F.col(base))
    span = "struct<k:int,s:int,e:int>"
    pass_at = "CASE " + " ".join(f"WHEN x.k = {k} THEN {t!r}D" for k, t in selector.thresholds.items()) + " ELSE 2D END"
    scored = f"transform({_proposals(f'coalesce(`{text}`, {chr(39)*2})', f'`{base}`')}, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'p', element_at(transform(array({_features('x')}), f -> {selector.score}), 1)))"
    chosen = f"array_sort(filter({scored}, x -> x.p >= {pass_at}))"
    # of spans that overlap, the better one stays: the state is the one in question, which the next clear one releases
    last = "struct<s:int,e:int,k:int,p:double>"
    step = "named_struct('l', CASE WHEN st.l IS NULL OR x.s >= st.l.e OR x.p > st.l.p OR (x.p = st.l.p AND x.e > st.l.e AND x.s = st.l.s) THEN x ELSE st.l END)"
    gone = f"CASE WHEN st.l IS NOT NULL AND x.s >= st.l.e THEN named_struct('k', st.l.k, 's', st.l.s, 'e', st.l.e) ELSE cast(null AS {span}) END"
    end = "named_struct('s', 2147483647, 'e', 2147483647, 'k', 0, 'p', 0D)"
    added = f"filter({_scan(f'array_append(c, {end})', f'named_struct({chr(39)}l{chr(39)}, cast(null AS {last}))', step, gone, span)}, x -> x IS NOT NULL)"
    return out.withColumn(spans, F.expr(f"element_at(transform(array({chosen}), c -> CASE WHEN size(c) = 0 THEN `{base}` ELSE array_sort(concat(`{base}`, {added})) END), 1)"))


def _written(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")


def redact(documents: DataFrame, selector: Selector, text: str = "text") -> DataFrame:
    """documents with every span replaced by its kind in brackets; n_chars, where there, counts the new text."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    base, spans = fresh(documents, "base_spans"), fresh(documents, "all_spans")
    own = "struct<s:int,e:int,k:int>"
    # spans that overlap are replaced as one, under the kind of the first
    step = "named_struct('l', CASE WHEN st.l IS NOT NULL AND x.s < st.l.e THEN named_struct('s', st.l.s, 'e', greatest(st.l.e, x.e), 'k', st.l.k) ELSE x END)"
    gone = f"CASE WHEN st.l IS NOT NULL AND x.s >= st.l.e THEN st.l ELSE cast(null AS {own}) END"
    sorted_ = f"array_append(array_sort(transform(`{spans}`, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k))), named_struct('s', 2147483647, 'e', 2147483647, 'k', 0))"
    merged = f"filter({_scan(sorted_, f'named_struct({chr(39)}l{chr(39)}, cast(null AS {own}))', step, gone, own)}, x -> x IS NOT NULL)"
    # the text is cut once for each block of spans, and each such part at its spans
    start = f"CASE WHEN i = 0 THEN 0 ELSE o[i * {BLOCK} - 1].e END"
    pieces = "transform(part, (x, j) -> concat(substring(cut, 1 + CASE WHEN j = 0 THEN 0 ELSE part[j - 1].e - start END, x.s - CASE WHEN j = 0 THEN start ELSE part[j - 1].e END), element_at(array(" + names + "), x.k + 1)))"
    block = f"""element_at(transform(array(named_struct('part', slice(o, i * {BLOCK} + 1, {BLOCK}), 'start', {start})), z -> element_at(transform(array(substring(`{text}`, 1 + z.start, element_at(z.part, -1).e - z.start)),
        cut -> array_join({pieces.replace('part', 'z.part').replace('start', 'z.start')}, '')), 1)), 1)"""
    new = f"""CASE WHEN size(`{spans}`) = 0 THEN `{text}` ELSE element_at(transform(array({merged}), o -> concat(array_join(transform(sequence(0, (size(o) - 1) div {BLOCK}), i -> {block}), ''), substring(`{text}`, 1 + element_at(o, -1).e))), 1) END"""
    out = with_spans(documents, selector, text, base, spans).withColumn(text, F.expr(new))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length(text).cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in documents.columns))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: base counts, the digest of the base spans, and all spans of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_spans(documents, train_selector(documents), base="base", spans="all")
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) AS bigint) AS n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("all").alias("spans"))
