"""Personal data by candidate gradient boosting, DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.llm.common import cut

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.99
AROUND = 24

# The base patterns. A match can only begin where a run of its first characters begins or where the match
# before it ended, and a run is not given back; that changes no match but keeps long runs linear and off the stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators, looser than the base patterns and of bounded length.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[(\[{](?:at|AT)[)\]}]\x20?)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[{](?:dot|DOT)[)\]}]\x20?)[A-Za-z0-9-]{1,63}){0,6}",
    "ip": r"[0-9]{1,3}(?:\x20?[.,]\x20?[0-9]{1,3}){3}",
    "card": r"(?<![0-9])[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])|[0-9](?:[\x20.-]?[0-9]){12,18}",
    "phone": r"[+(]?[0-9][\x20().0-9-]{6,18}[0-9]",
}
WORDS = {
    "email": "mail|contact|write|@",
    "ip": "ip|host|server|addr",
    "card": "card|visa|master|credit|tarjeta|karte|carte",
    "phone": "phone|tel|call|fax|mobil",
}


SEEDS = 6_000
HINTS = {
    "email": ["mail", "e-mail", "contact", "write to", "reach", "ask", "correo"],
    "ip": ["ip", "host", "server", "ip address", "addr", "from host"],
    "card": ["card", "visa", "credit card", "mastercard", "tarjeta", "karte no", "carte"],
    "phone": ["phone", "tel", "tel.", "call", "fax", "mobile", "telefono", "telefon"],
}
NEUTRAL = ["order", "number", "ref", "page", "item", "see", "invoice", "year", "about", "until", "total", "code", "der", "el", "les", "version"]


SPANS = "array<struct<start:int,end:int,found:string,before:string,after:string>>"


def _may(text: Column, kind: str, loose: bool) -> Column:
    """A cheap test that every text with a match passes."""
    if kind != "email":
        return text.rlike("[0-9]")
    return F.contains(text, F.lit("@")) | text.rlike(r"[(\[{](?:at|AT)[)\]}]") if loose else F.contains(text, F.lit("@"))


def _matched(docs: DataFrame, patterns: dict[str, tuple[str, bool]]) -> DataFrame:
    """For each name, what its pattern matches in ``text`` (h_name) and what that leaves between (g_name), as columns.

    They are columns, so that the steps that need them don't match again.
    """
    text, out = F.col("text"), {}
    for name, (pattern, loose) in patterns.items():
        may = _may(text, name.split("_")[1], loose)
        out[f"h_{name}"] = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        out[f"g_{name}"] = F.when(may, F.split(text, pattern, -1))
    return docs.select(*[c for c in docs.columns if c != "text"], *[v.alias(c) for c, v in out.items()])


def _spans(name: str, around: int = 0) -> Column:
    """The matches as structs (start, end, found, before, after), in code points; end is exclusive.

    What a pattern cuts a text into and what it matches, put together again, give the positions.
    """
    hits, gaps = F.col(f"h_{name}"), F.col(f"g_{name}")
    pairs = F.arrays_zip(hits.alias("h"), F.slice(gaps, 1, F.size(hits)).alias("g"), F.slice(gaps, 2, F.size(hits)).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["h"])
        own = F.struct(start.alias("start"), end.alias("end"), x["h"].alias("found"), F.right(x["g"], F.lit(around)).alias("before"), F.left(x["n"], F.lit(around)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    none = F.array().cast(SPANS)
    folded = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, folded).otherwise(none)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = d * 2
        return F.when((n - i) % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    """Whether a base match passes its kind's check."""
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) == 0, True).when(F.length(p) > 3, False).otherwise(p.try_cast("int") <= 255))
    digits = _digits(found)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _whole(kind: str, s: Column) -> Column:
    """Whether a candidate by itself is a valid base span."""
    return (F.regexp_extract(s["found"], f"^(?:{BASE[kind]})$", 0) != "") & _valid(kind, s["found"])


def _personal(kind: str, s: Column) -> Column:
    """Whether a candidate is personal data: a valid base span, or one that is valid once it is normalised.

    The latter has its e-mail marks undone, its separators evened or its spaces dropped; it may not be a part of a longer
    run and, but for e-mail addresses, needs a word of its kind before it.
    """
    found, before, after = s["found"], s["before"], s["after"]
    digits = _digits(found)
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(found, r"\x20?[(\[{](?:at|AT)[)\]}]\x20?", "@"), r"\x20?[(\[{](?:dot|DOT)[)\]}]\x20?", ".")
        sound = plain.rlike(r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$")
    elif kind == "ip":
        sound = _valid(kind, F.regexp_replace(found, r"\x20?[.,]\x20?", "."))
    elif kind == "card":
        sound = F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    else:
        sound = _valid(kind, found)
    free = ~before.rlike("[0-9A-Za-z.+-]$") & ~after.rlike("^[0-9A-Za-z@-]")
    hinted = F.lit(True) if kind == "email" else F.lower(before).rlike(WORDS[kind])
    return _whole(kind, s) | (sound & free & hinted)


def _base(kind: str) -> Column:
    """The base spans of a kind, from the columns that :func:`_matched` gives."""
    return F.filter(_spans(f"base_{kind}"), lambda s: _valid(kind, s["found"]))


def features(kind: str, s: Column) -> dict[str, Column]:
    """Format and context features of a candidate span."""
    found, before, after = s["found"], s["before"], s["after"]
    n = F.length(found)
    digits = F.length(_digits(found))
    summed = F.when(digits.between(13, 19), _luhn(_digits(found))).otherwise(False) if kind == "card" else F.lit(False)

    def count(pattern: str) -> Column:
        return n - F.length(F.regexp_replace(found, pattern, ""))

    def yes(c: Column) -> Column:
        return c.cast("double")

    return {
        **{f"is_{k}": F.lit(float(k == kind)) for k in KINDS},
        "length": n.cast("double"),
        "digits": digits.cast("double"),
        "dots": count(r"\.").cast("double"),
        "spaces": count(" ").cast("double"),
        "dashes": count("-").cast("double"),
        "brackets": count(r"[()\[\]{}]").cast("double"),
        "luhn": yes(summed),
        "base": yes(_whole(kind, s)),
        "plus": yes(F.startswith(found, F.lit("+"))),
        "at_sign": yes(F.contains(found, F.lit("@"))),
        "other": (n - digits - count(r"[\x20.()+-]")).cast("double"),
        "touches_before": yes(before.rlike("[0-9A-Za-z.+-]$")),
        "touches_after": yes(after.rlike("^[0-9A-Za-z@-]")),
        "digits_around": F.length(_digits(F.concat(before, after))).cast("double"),
        "quoted": yes(before.rlike("[\"'=]\\s*$")),
        "hinted": yes(F.lower(before).rlike(WORDS[kind])),
    }


@dataclass
class Model:
    """Boosted trees as nested tests, and the score from which a kind's candidates count."""

    trees: list = field(default_factory=list)  # (weight, tree); a tree is a number or (feature, threshold, left, right)
    names: list[str] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, values: dict[str, Column]) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            at, threshold, left, right = node
            return F.when(values[self.names[at]] <= threshold, walk(left)).otherwise(walk(right))

        margin = reduce(lambda a, b: a + b, [F.lit(float(w)) * walk(t) for w, t in self.trees])
        return 1 / (1 + F.exp(-2 * margin))


def _tree(node):
    """A tree of the fitted model as nested tuples."""
    if node.numDescendants() == 0:
        return node.prediction()
    split = node.split()
    return (split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


def seeds(spark: SparkSession, n: int = SEEDS) -> DataFrame:
    """(text, held, kind, truth): n made texts with one item each, normal, obfuscated, spaced anew, or cut, and whether it is personal data.

    They are the same on every table: numbers, names and words come from the row's number by hashes. Half the items are personal data of their
    kind after a word of it; the others have the wrong check digit, no host, parts above 255, or stand after words of no kind.
    """

    def draw(salt: str, size: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(size))

    def pick(salt: str, options: list) -> Column:
        return F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in options]), draw(salt, len(options)).cast("int"))

    def number(salt: str, size: int) -> Column:
        return F.lpad(draw(salt, 10**size).cast("string"), size, "0")

    def part(text: Column, *sizes: int) -> list[Column]:
        starts = [1 + sum(sizes[:i]) for i in range(len(sizes))]
        return [text.substr(a, b) for a, b in zip(starts, sizes, strict=True)]

    def joined(mark: Column, parts: list[Column]) -> Column:
        return F.concat(*[x for p in parts for x in (mark, p)][1:])

    truth = F.col("truth")
    name, host = (F.left(F.translate(number(x, 9), "0123456789", "aneirstolm"), (draw(f"{x} length", 8) + 2).cast("int")) for x in ("name", "host"))
    at, dot = pick("at", [" (at) ", "(at)", " [at] ", " {AT} ", "[AT]"]), pick("dot", [" (dot) ", "(dot)", " [dot] ", "[DOT]", "."])
    mail = F.when(truth, F.concat(name, pick("second", ["", ".k", "-x", "_7"]), at, host, dot, pick("end", ["org", "com", "net", "ec"]))).otherwise(F.concat(name, at, pick("noon", ["noon", "home", "work", host, host])))
    octets = [draw(f"octet{i}", 256) for i in range(4)]
    ip = joined(pick("ip mark", [". ", " . ", ",", ", ", " ."]), [F.when(truth | (draw("large", 2) == 0), o).otherwise(o + 256).cast("string") for o in octets])
    body = F.concat(F.lit("4"), number("card a", 7), number("card b", 7))
    body = F.when(draw("short", 3) == 0, F.left(body, F.lit(14))).otherwise(body)
    check = F.get(F.filter(F.array(*[F.lit(str(i)) for i in range(10)]), lambda c: _luhn(F.concat(body, c))), F.lit(0))
    check = F.when(truth | (draw("unhinted", 2) == 0), check).otherwise(((check.cast("int") + 1 + draw("wrong", 9)) % 10).cast("string"))
    whole = F.concat(body, check)
    mark = pick("card mark", ["", " ", "-", "."])
    card = F.when(F.length(whole) == 16, joined(mark, part(whole, 4, 4, 4, 4))).otherwise(joined(mark, part(whole, 4, 6, 5)))
    d = F.concat(number("phone a", 7), number("phone b", 6))
    forms = [
        F.concat(F.lit("0"), F.concat_ws(" ", *part(d, 2, 3, 4))), F.concat(F.lit("("), part(d, 3)[0], F.lit(") "), F.concat_ws("-", *part(d, 3, 3, 4)[1:])), F.concat_ws("-", *part(d, 3, 3, 4)), F.concat_ws(" ", *part(d, 3, 1, 3, 4)),
        F.concat_ws(" ", *part(d, 2, 2, 2, 2, 2)), F.concat_ws(".", *part(d, 3, 3, 4)), F.concat(F.lit("0"), F.concat_ws("-", *part(d, 2, 7))), F.concat_ws(" ", *part(d, 3, 3, 4)),
    ]
    items = {"email": mail, "ip": ip, "card": card, "phone": pick("phone form", forms)}
    wrong_card = (F.col("kind") == "card") & (draw("unhinted", 2) != 0)
    wrong_ip = (F.col("kind") == "ip") & (draw("large", 2) != 0)
    hint = F.when(truth | wrong_card | wrong_ip | (F.col("kind") == "email"), F.coalesce(*[F.when(F.col("kind") == k, pick("hint", h)) for k, h in HINTS.items()])).otherwise(pick("neutral", NEUTRAL))
    item = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in items.items()])
    rows = spark.range(n).withColumns({"kind": F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("id") % 4).cast("int")), "truth": F.floor(F.col("id") / 4) % 2 == 0})
    text = F.concat(pick("first", NEUTRAL), F.lit(" "), pick("word", ["and", "of", "thing", "ein", "una", "pour"]), F.lit(" "), hint, pick("gap", [" ", ": ", " ", " is "]), item, pick("after", [" now", ".", "", " and more", ", ok"]))
    return rows.select(text.alias("text"), (draw("held", 5) == 0).alias("held"), "kind", "truth")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Boost trees on all candidates of all documents and of made texts, and calibrate a threshold for each kind.

    A candidate is labelled by :func:`_personal`, wider than the base patterns. The ``SEEDS`` texts of :func:`seeds` are
    added, whose labels are what they were made as, or that they are base spans; with them all kinds have a threshold on any table, an empty one too. Candidates with the same
    features and label are one row with their number as its weight, so the trees see every candidate, but few rows. Four fifths of the documents, by the
    MD5 of their id, train the trees; on all of the last fifth the least score is found from which ``PRECISION`` of a kind's candidates have the label.
    A kind for which no score reaches that, or documents without both labels, select no candidates.
    """
    made = cut(seeds(docs.sparkSession))  # its long expressions stay out of later plans
    mark = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.conv(F.substring(mark, 11, 8), 16, 10).cast("long") % 5 == 0).alias("held"))
    kinds = []
    for k in KINDS:
        rows = _matched(texts, {f"loose_{k}": (LOOSE[k], True)}).select("held", F.explode(_spans(f"loose_{k}", AROUND)).alias("s"))
        label = _personal(k, F.col("s")).cast("double")
        more = _matched(made.withColumn("known", (F.col("truth") & (F.col("kind") == k)).cast("double")).drop("kind", "truth"), {f"loose_{k}": (LOOSE[k], True)})
        more = more.select("held", "known", F.explode(_spans(f"loose_{k}", AROUND)).alias("s"))
        for found, own in ((rows, label), (more, F.greatest("known", _whole(k, F.col("s")).cast("double")))):
            kinds.append(found.select("held", F.lit(k).alias("kind"), own.alias("label"), *[v.alias(c) for c, v in features(k, F.col("s")).items()]))
    names = [c for c in kinds[0].columns if c not in ("held", "kind", "label")]
    rows = reduce(DataFrame.unionByName, kinds).groupBy("held", "kind", "label", *names).count()  # equal rows are one
    rows = rows.persist()
    try:
        labels = {r["label"] for r in rows.filter("not held").select("label").distinct().collect()}
        if len(labels) < 2:
            return Model()
        ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
        bins = max(100, math.isqrt(rows.count()) + 1)  # up to bins^2 rows Spark takes the trees' cuts from all rows, beyond from a sample of them
        fitted = GBTClassifier(maxIter=8, maxDepth=3, maxBins=bins, seed=7, weightCol="count").fit(ready.filter("not held"))
        java = fitted._java_obj
        model = Model([(w, _tree(t.rootNode())) for w, t in zip(java.treeWeights(), java.trees(), strict=True)], names)
        scored = rows.filter("held").select("kind", "label", "count", model.score({c: F.col(c) for c in names}).alias("score"))
        levels = scored.groupBy("kind", "score").agg(F.sum("count").alias("n"), F.sum(F.col("label") * F.col("count")).alias("good"))
        for kind in KINDS:
            n = good = 0.0
            for r in sorted((r for r in levels.collect() if r["kind"] == kind), key=lambda r: -r["score"]):
                n, good = n + r["n"], good + r["good"]
                if good >= PRECISION * n:
                    model.thresholds[kind] = r["score"]
        return model
    finally:
        rows.unpersist()


def all_spans(docs: DataFrame, model: Model) -> DataFrame:
    """Replace ``text`` (without nulls) by base_k and all_k for each kind k: its base spans, and with those selected."""
    rest = [c for c in docs.columns if c != "text"]
    kinds = list(model.thresholds)
    patterns = {f"base_{k}": (BASE[k], False) for k in KINDS} | {f"loose_{k}": (LOOSE[k], True) for k in kinds}

    def scored(kind: str) -> Column:
        return F.transform(
            _spans(f"loose_{kind}", AROUND),
            lambda s: F.struct(s.alias("span"), F.struct(*[v.alias(c) for c, v in features(kind, s).items()]).alias("f")),
        )

    def selected(kind: str) -> Column:
        chosen = F.filter(F.col(f"scored_{kind}"), lambda x: model.score({c: x["f"][c] for c in model.names}) >= model.thresholds[kind])
        return F.transform(chosen, lambda x: x["span"])

    def both(kind: str) -> Column:
        if kind not in kinds:
            return F.col(f"base_{kind}")
        base = F.col(f"base_{kind}")
        fresh = F.filter(F.col(f"more_{kind}"), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.when(F.size(F.col(f"more_{kind}")) > 0, F.array_sort(F.concat(base, fresh))).otherwise(base)

    matched = _matched(docs, patterns)
    spanned = matched.select(*rest, *[_base(k).alias(f"base_{k}") for k in KINDS], *[scored(k).alias(f"scored_{k}") for k in kinds])
    chosen = spanned.select(*rest, *[f"base_{k}" for k in KINDS], *[selected(k).alias(f"more_{k}") for k in kinds])
    return chosen.select(*rest, *[f"base_{k}" for k in KINDS], *[both(k).alias(f"all_{k}") for k in KINDS])


def _joined(spans: dict[str, Column]) -> Column:
    def named(kind: str) -> Column:
        return F.transform(spans[kind], lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.concat_ws(",", *[named(k) for k in KINDS])


def find_personal_data(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The personal data of each whole text, as spans in code points with exclusive ends; the scan is not shuffled.

    Base spans always count: leftmost non-overlapping matches of each kind's pattern that pass its check. High-recall
    generators propose further spans, which overlap each other and other kinds; boosted trees score them by format and
    context, and those that reach their kind's calibrated threshold and overlap no base span of the kind are added.

    Returns id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256`` (of the base spans as
    kind:start:end, by kind, then start, joined by commas), ``spans`` (all of them, joined likewise).

    Null counts as empty; a text without spans has the digest of an empty text and empty ``spans``. Rows with repeated
    or null ids each have a result; other columns are ignored; an empty table gives an empty result.
    """
    if model is None:
        model = fit(docs, id_col, text_col)
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = all_spans(narrow, model)
    own, every = ({k: F.col(f"{which}_{k}") for k in KINDS} for which in ("base", "all"))
    return found.select(F.col("id").alias(id_col), *[F.size(own[k]).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(own), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redact(docs: DataFrame, model: Model, text_col: str = "text", mask: str = "X") -> DataFrame:
    """The documents with every code point of every span replaced by ``mask``; null stays null."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = all_spans(docs.select(whole.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), model)
    spans = F.array_sort(F.concat(*[F.col(f"all_{k}") for k in KINDS]))

    def blot(acc: Column, s: Column) -> Column:
        return F.overlay(acc, F.repeat(F.lit(mask), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"])

    return found.select(*[F.aggregate(spans, F.col("row")[c], blot).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
