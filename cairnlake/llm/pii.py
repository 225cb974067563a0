"""Personal data: high-recall generators, boosted trees on span features, calibrated choice.

Base spans follow fixed patterns and checks and are always found. Wider generators propose
further spans, overlapping each other and the base ones. Each candidate has small categorical
features of its format and its context, so all candidates of the corpus fit one bounded table
of counts per combination (at most 2 * CELLS rows). Gradient boosted trees of depth two are fitted
to that table. The label is evidence in the candidate and before it (check digits, form, a cue
word), whatever the base rules make of it. Scores are calibrated by isotonic regression over all
counts, and a generator's own cut rises until its candidates in a quarter of the texts, kept out
of the fit, are right often enough. Candidates outside all base spans that reach the cut of
THRESHOLD are added. Model and choice are plain expressions; no Python touches a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Base kinds in order. The patterns find what the contract's simpler ones find, in linear time:
#: runs are possessive and can only begin where the plain pattern's leftmost match can. Cards
#: are bounded to 14 to 19 digits, as longer or shorter runs fail anyway.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
#: Generators beyond the base patterns: anything around an @ or (at), and runs of digits with
#: the marks that phone, card and identity numbers have.
MAIL_LIKE = r"[\p{L}\p{N}._%+-]{1,64}\x20?(?:@|[\[(]at[\])])\x20?[\p{L}\p{N}._-]{1,255}"
NUMBER_LIKE = r"(?<![\p{L}\p{N}])[+(]?[0-9][0-9\x20().-]{6,28}[0-9](?![\p{L}\p{N}])"
#: Card numbers standing alone, each for itself also where several follow one another.
CARD_LIKE = r"(?<![\p{L}\p{N}])(?<![0-9]\.)(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{2,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5})(?![\p{L}\p{N}])(?!\.[0-9])"
#: Keys, tokens and hashes: long runs of the characters that hexadecimal and base64 use.
SECRET_LIKE = r"(?<![\p{L}\p{N}+/_=.-])[A-Za-z0-9+/_-]{20,512}+={0,2}(?![\p{L}\p{N}+/_=-])"
GENERATORS = (("mail_like", MAIL_LIKE), ("number_like", NUMBER_LIKE), ("card_like", CARD_LIKE), ("secret_like", SECRET_LIKE))
#: A cue word right before a span, of at most CUE_CHARS characters with what may stand between.
CUES = r"(?i)(?<![\p{L}\p{N}])(?:tel|telephone|phone|call|fax|mobile|card|account|iban|e-?mail|mail|contact|ssn|passport)[^\p{L}\p{N}\n]{0,4}(?:(?:no|nr|number|is|at|me|us|on|to)[^\p{L}\p{N}\n]{1,3}){0,2}$"
SECRET_CUES = r"(?i)(?<![\p{L}\p{N}])(?:[\p{L}\p{N}]{1,20}[_-])?(?:token|secret|key|apikey|password|passwd|pwd|auth|bearer|credentials?)[\"']?\x20{0,2}[:=]{0,2}\x20{0,2}[\"']?$"
CUE_CHARS = 40
#: Calibrated chance from which a candidate is added; trees, their learning rate.
THRESHOLD, TREES, RATE = 0.98, 24, 0.4
#: Values of each feature, 0 up; their product bounds the table of counts.
FEATURES = {"generator": 4, "digits": 6, "lead": 3, "marks": 4, "valid": 4, "cue": 2}
CELLS = int(np.prod(list(FEATURES.values())))
SPAN = "array<struct<kind: string, start: long, end: long, found: string>>"
#: A candidate has what stands before it, too: cutting that out of the text would cost its whole length.
CANDIDATE = SPAN.replace("found: string", "found: string, before: string")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _matches(text: Column, pattern: str, kind: str, before: bool = False) -> Column:
    """All matches of a pattern with their places in characters, left to right; with `before`, the
    CUE_CHARS characters that stand before each, too.

    Appending copies an array, so places are summed in blocks of about the square root of the
    number of matches: first the blocks' beginnings, then the places in each block by itself.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.expr(f"CAST(array() AS {CANDIDATE if before else SPAN})")
    tail = lambda *parts: F.right(F.concat(*parts), F.lit(CUE_CHARS))

    def placed(pairs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(pairs).cast("double"))).cast("int"), F.lit(16))
        count = F.ceil(F.size(pairs) / size).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(pairs, b * size + 1, size))
        return _let(cut, in_blocks)

    def in_blocks(blocks: Column) -> Column:
        long = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, x: n + F.length(x["gap"]) + F.length(x["found"]))
        first = F.array(F.lit(0).cast("long"))
        begins = F.aggregate(blocks, first, lambda s, block: F.array_append(s, F.element_at(s, -1) + long(block)))
        return _let(begins, lambda at: F.flatten(F.transform(blocks, lambda block, i: in_block(block, F.get(at, i), F.when(i > 0, last(F.get(blocks, i - 1))).otherwise(""))))) if before else _let(begins, lambda at: F.flatten(F.transform(blocks, lambda block, i: in_block(block, F.get(at, i), F.lit("")))))

    def last(block: Column) -> Column:
        """What a block ends with: 16 matches and more, so it has that many characters."""
        return tail(F.array_join(F.transform(block, lambda x: F.concat(x["gap"], x["found"])), ""))

    def in_block(block: Column, begin: Column, context: Column) -> Column:
        start = F.struct(begin.alias("at"), context.alias("tail"), none.alias("out"))

        def step(s: Column, x: Column) -> Column:
            a = s["at"] + F.length(x["gap"])
            b = a + F.length(x["found"])
            fields = [F.lit(kind).alias("kind"), a.cast("long").alias("start"), b.cast("long").alias("end"), x["found"].alias("found")]
            if not before:
                return F.struct(b.cast("long").alias("at"), s["tail"].alias("tail"), F.array_append(s["out"], F.struct(*fields)).alias("out"))
            one = F.struct(*fields, tail(s["tail"], x["gap"]).alias("before"))
            return F.struct(b.cast("long").alias("at"), tail(s["tail"], x["gap"], x["found"]).alias("tail"), F.array_append(s["out"], one).alias("out"))

        return F.aggregate(block, start, step)["out"]

    return _let(F.struct(found.alias("f"), gaps.alias("g")), lambda m: F.when(F.size(m["f"]) > 0, _let(F.slice(F.arrays_zip(m["g"].alias("gap"), m["f"].alias("found")), F.lit(1), F.size(m["f"])), placed)).otherwise(none))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), step) % 10 == 0)


def base_spans(text: Column) -> Column:
    """Base spans of a text without nulls, kind by kind; texts that can't have any are told
    by cheaper tests first."""
    none = F.expr(f"CAST(array() AS {SPAN})")
    n = lambda x: F.length(_digits(x["found"]))
    email = F.when(F.contains(text, F.lit("@")), _matches(text, EMAIL, "email")).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_matches(text, IP, "ip"), lambda x: x["found"].rlike(OCTETS))).otherwise(none)
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), F.filter(_matches(text, CARD, "card"), lambda x: _luhn(_digits(x["found"])))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(_matches(text, PHONE, "phone"), lambda x: n(x).between(10, 15))).otherwise(none)
    return F.concat(email, ip, card, phone)


def candidates(text: Column) -> Column:
    """Spans of the generators, overlapping as they come."""
    none = F.expr(f"CAST(array() AS {CANDIDATE})")
    mail = F.when(F.contains(text, F.lit("@")) | text.rlike(r"[\[(]at[\])]"), _matches(text, MAIL_LIKE, "mail_like", True)).otherwise(none)
    number = F.when(text.rlike(r"[0-9][0-9\x20().-]{6}"), F.filter(_matches(text, NUMBER_LIKE, "number_like", True), lambda x: F.length(_digits(x["found"])) >= 7)).otherwise(none)
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _matches(text, CARD_LIKE, "card_like", True)).otherwise(none)
    sure = F.filter(card, lambda x: _luhn(_digits(x["found"])))
    secret = F.when(text.rlike(r"[A-Za-z0-9+/_-]{20}"), F.filter(_matches(text, SECRET_LIKE, "secret_like", True), lambda x: x["found"].rlike("[0-9]") & x["found"].rlike("[A-Za-z]"))).otherwise(none)
    apart = _let(sure, lambda known: F.filter(number, lambda x: ~_meets(x, known)))
    return F.concat(mail, apart, card, secret)


def span_features(x: Column) -> dict[str, Column]:
    """Categorical format and context features of one candidate."""
    found, digits = x["found"], _digits(x["found"])
    n = F.length(digits)
    mail, secret, long_ = x["kind"] == "mail_like", x["kind"] == "secret_like", F.length(found)
    hexed = found.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    size = F.when(long_ == 32, 1).when(long_ == 40, 2).when(long_ == 64, 3).when(long_ > 64, 4).when(long_ > 32, 5).otherwise(0)
    band = F.when(mail, F.least(n, F.lit(5))).when(secret, size).when(n < 9, 0).when(n < 10, 1).when(n < 14, 2).when(n <= 15, 3).when(n <= 19, 4).otherwise(5)
    quoted = F.right(x["before"], F.lit(1)).isin('"', "'")
    lead = F.when(secret, quoted.cast("int")).when(found.startswith("+"), 1).when(found.rlike(r"^\([0-9]{2,5}\)[0-9\x20.-]+$"), 2).otherwise(0)
    at = F.when(found.rlike(r"[\[(]at[\])]"), 1).when(found.rlike(r"\x20@|@\x20"), 2).otherwise(0)
    both = found.rlike("[a-z]") & found.rlike("[A-Z]")
    marks = F.when(mail, at).when(secret, F.when(found.rlike("[/_-]"), 3).when(both, 2).when(hexed, 0).otherwise(1)).when(found.rlike(r"^[0-9]+$"), 0).when(F.contains(found, F.lit("(")), 1).when(found.rlike(r"^[0-9]+(?:\.[0-9]+)+$"), 2).otherwise(3)
    domain = found.rlike(r"[A-Za-z0-9-]\.[A-Za-z]{2,}")
    plain = found.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]")
    share = F.floor(4 * n / F.length(found))  # of digits
    valid = F.when(mail, domain.cast("int") + 2 * plain.cast("int")).when(secret, F.least(share, F.lit(3))).otherwise(_luhn(digits).cast("int") + 2 * found.rlike(OCTETS).cast("int"))
    before = x["before"]
    cue = F.when(secret, before.rlike(SECRET_CUES)).otherwise(before.rlike(CUES))
    out = {"generator": F.when(mail, 0).when(x["kind"] == "number_like", 1).when(secret, 3).otherwise(2), "digits": band, "lead": lead, "marks": marks, "valid": valid, "cue": cue.cast("int")}
    return {k: v.cast("int") for k, v in out.items()}


def evident(x: Column, f: dict[str, Column]) -> Column:
    """Whether form or context speak for personal data: a mail address with a domain, a card
    number of right check digit, an address of four octets, a phone number with + or its area
    code in brackets, or a cue word before. The base spans play no part."""
    n, cue = F.length(_digits(x["found"])), f["cue"] == 1
    mail = (f["valid"] % 2 == 1) & ((f["marks"] != 2) | cue)
    number = (f["valid"] >= 2) | (n.between(10, 15) & (f["lead"] > 0)) | (n.between(7, 19) & cue)
    secret = cue | ((f["marks"] == 0) & f["digits"].between(1, 3) & (f["lead"] == 1))  # or a quoted hash of a usual length
    return F.when(f["generator"] == 0, mail).when(f["generator"] == 1, number).when(f["generator"] == 3, secret).otherwise((f["valid"] % 2 == 1) | cue)


def _meets(x: Column, spans: Column) -> Column:
    """Whether x meets any of the spans, which are in order and don't overlap: of those that begin
    before x ends the last one, found by halving, ends last."""
    n = F.size(spans)
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(1.0))).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"] + 1) / 2).cast("int")
        before = F.coalesce(F.try_element_at(spans, F.greatest(mid, F.lit(1)))["start"] < x["end"], F.lit(False))
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(~done & before, mid).otherwise(s["lo"]).alias("lo"), F.when(done | before, s["hi"]).otherwise(mid - 1).alias("hi"))

    last = F.aggregate(halvings, start, halve)["lo"]
    return F.coalesce((last > 0) & (F.try_element_at(spans, F.greatest(last, F.lit(1)))["end"] > x["start"]), F.lit(False))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def _outside(spans: Column, base: Column) -> Column:
    """The spans that meet no base span, of whatever kind."""
    kinds = F.struct(*[_of_kind(base, k).alias(k) for k in KINDS])

    def apart(by: Column) -> Column:
        free = lambda x: ~(_meets(x, by[KINDS[0]]) | _meets(x, by[KINDS[1]]) | _meets(x, by[KINDS[2]]) | _meets(x, by[KINDS[3]]))
        return F.filter(spans, free)

    return _let(kinds, apart)


class Boosted:
    """Boosted depth-two trees on rows (features..., count, positives), with calibration; rows
    held out of the fit count for calibration and for each generator's own cut."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, rate: float = RATE, held: np.ndarray | None = None):
        columns = lambda r: (r[:, : len(FEATURES)].astype(int), r[:, -2].astype(float), r[:, -1].astype(float))
        x, n, pos = columns(rows)
        self.trees: list[tuple] = []
        score = np.zeros(len(x))
        tests = [(f, v) for f, k in enumerate(FEATURES.values()) for v in range(k)]
        for _ in range(trees if len(x) else 0):
            p = 1 / (1 + np.exp(-score))
            grad, hess = pos - n * p, n * p * (1 - p)
            best = self._split(x, grad, hess, tests, np.ones(len(x), bool))
            if best is None:
                break
            side = x[:, best[0]] == best[1]
            leaves = []
            for on in (side, ~side):
                sub = self._split(x, grad, hess, tests, on)
                parts = [on] if sub is None else [on & (x[:, sub[0]] == sub[1]), on & (x[:, sub[0]] != sub[1])]
                values = [rate * grad[m].sum() / (hess[m].sum() + 1) for m in parts]
                for m, v in zip(parts, values, strict=True):
                    score[m] += v
                leaves.append((sub, values))
            self.trees.append((best, leaves))
        held = rows[:0] if held is None else held
        hx, hn, hpos = columns(held)
        hscore = np.array([self.value(v) for v in hx])
        self.steps = self._calibrate(np.r_[score, hscore], np.r_[n, hn], np.r_[pos, hpos])
        self.held = [(g, s, a, b) for g, s, a, b in zip(hx[:, 0], hscore, hn, hpos, strict=True)]

    @staticmethod
    def _split(x, grad, hess, tests, on):
        gain = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1)
        whole, best, most = gain(on), None, 1e-6
        for f, v in tests:
            m = on & (x[:, f] == v)
            if m.any() and (on & ~m).any() and (g := gain(m) + gain(on & ~m) - whole) > most:
                best, most = (f, v), g
        return best

    @staticmethod
    def _calibrate(score, n, pos) -> list[tuple[float, float]]:
        """Isotonic regression: (score from, chance), rising; chances are shrunk by one
        imagined negative in each block."""
        blocks: list[list[float]] = []
        for s in sorted(set(np.round(score, 9))):
            m = np.isclose(score, s, atol=1e-9)
            blocks.append([s, n[m].sum(), pos[m].sum()])
            while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
                _, a, b = blocks.pop()
                blocks[-1][1] += a
                blocks[-1][2] += b
        return [(s, b / (a + 1)) for s, a, b in blocks]

    def value(self, values: Sequence[int]) -> float:
        """The score of one feature combination."""
        total = 0.0
        for root, leaves in self.trees:
            sub, v = leaves[0 if values[root[0]] == root[1] else 1]
            total += v[0] if sub is None or values[sub[0]] == sub[1] else v[1]
        return total

    def score(self, f: dict[str, Column]) -> Column:
        names, total = list(FEATURES), F.lit(0.0)
        test = lambda t: f[names[t[0]]] == t[1]
        for root, leaves in self.trees:
            sides = [F.lit(float(v[0])) if sub is None else F.when(test(sub), float(v[0])).otherwise(float(v[1])) for sub, v in leaves]
            total = total + F.when(test(root), sides[0]).otherwise(sides[1])
        return total

    def least_score(self, threshold: float, generator: int | None = None) -> float | None:
        """The score from which the calibrated chance reaches the threshold; for a generator,
        the least from there on at which its held-out candidates don't fall short of it."""
        least = next((s for s, chance in self.steps if chance >= threshold), None)
        if least is None or generator is None:
            return least
        mine = [(s, n, pos) for g, s, n, pos in self.held if g == generator and s >= least - 1e-9]
        for cut in sorted({least, *(s for s, _, _ in mine)}):
            over = [(n, pos) for s, n, pos in mine if s >= cut - 1e-9]
            if sum(p for _, p in over) >= threshold * sum(n for n, _ in over):
                return cut
        return None

    def chosen(self, threshold: float) -> list[tuple[int, ...]]:
        """All feature combinations whose calibrated chance reaches the threshold."""
        least = self.least_score(threshold)
        if least is None:
            return []
        return [v for v in itertools.product(*(range(k) for k in FEATURES.values())) if self.value(v) >= least - 1e-9]


def fit_candidates(spanned: DataFrame) -> Boosted:
    """The model for a frame with text, base and candidates: counts over all documents."""
    def told(x: Column) -> Column:
        return F.struct(*[c.alias(k) for k, c in span_features(x).items()], x["found"].alias("found"))

    # features go out, not texts: exploded rows would carry a copy of the text each
    one = spanned.select((F.pmod(F.xxhash64("text"), F.lit(4)) == 3).alias("held"), F.explode(F.transform("candidates", told)).alias("x"))
    one = one.select("held", *[F.col("x")[k].alias(k) for k in FEATURES], "x")
    hit = evident(F.col("x"), {k: F.col(k) for k in FEATURES}).cast("int").alias("hit")
    counts = one.select("held", *FEATURES, hit).groupBy("held", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("pos"))
    rows = np.array(sorted(tuple(r) for r in counts.collect()), dtype=float).reshape(-1, len(FEATURES) + 3)  # at most 2 * CELLS rows
    held = rows[:, 0] == 1
    return Boosted(rows[~held, 1:], held=rows[held, 1:])


def find_pii(documents: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, text (null as empty), base and added: arrays of (kind, start, end,
    found), places in characters, end exclusive. Added spans meet no base span. A kept column
    named text, base, added or candidates is refused.

    Whole texts are searched. Empty texts and empty tables have no span; rows repeat as in the
    input; columns that aren't kept play no part.
    """
    if clash := {"text", "base", "added", "candidates"} & set(keep):
        raise ValueError(f"kept columns would be hidden: {sorted(clash)}; wrap them in a struct")
    t = F.coalesce(F.col(text), F.lit(""))
    spanned = documents.select(*keep, t.alias("text")).withColumn("base", base_spans(F.col("text"))).withColumn("candidates", candidates(F.col("text")))
    model = fit_candidates(spanned)
    cuts = [model.least_score(threshold, g) for g in range(len(GENERATORS))]
    if all(c is None for c in cuts):
        added = F.expr(f"CAST(array() AS {SPAN})")
    else:
        rest = _outside(F.col("candidates"), F.col("base"))
        cut = lambda x: F.coalesce(*[F.when(x["kind"] == k, F.lit(c - 1e-9)) for (k, _), c in zip(GENERATORS, cuts, strict=True) if c is not None])
        added = F.filter(rest, lambda x: F.coalesce(model.score(span_features(x)) >= cut(x), F.lit(False)))
        added = F.transform(added, lambda x: F.struct(*[x[n].alias(n) for n in ("kind", "start", "end", "found")]))
    return spanned.withColumn("added", added).drop("candidates")


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, *(g for g, _ in GENERATORS))])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(kinds, x["kind"]).alias("at"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(_ordered(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or group of overlapping spans, replaced by its first kind."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        new = F.concat(s["out"], gap, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], new).otherwise(s["out"]).alias("out"))

    done = F.aggregate(_ordered(spans), start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the base spans' counts and digest, all spans, and how many there are."""
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    n = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
