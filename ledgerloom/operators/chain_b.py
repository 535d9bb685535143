"""Chain B: settlement net against bank lines.

Phases follow the strength of their evidence, each a pure function of what the phases before left over: references,
unique amount and date, suggested amount groups, leftovers. No phase pairs all records of an account: amounts meet by
equality on (account, currency, amount, day) of daily counts, and group suggestions look at bounded arrays a day. Where
many settlements share many lines, the evidence names the class of these lines, which is listed once.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import money
from ..functions.text import reference_tokens
from ..lineage import settle, settle_all
from ..rules import Rules
from .components import roots
from .results import CLASS, EVIDENCE, EXCEPTION, GROUP, MEMBER, STATE, Found, shaped

ACCOUNT = ["bank_account", "currency"]


def stl_key(batch: Column | str) -> Column:
    return F.concat(F.lit("B|STL|"), F.col(batch) if isinstance(batch, str) else batch)


def bank_key(line: Column | str) -> Column:
    return F.concat(F.lit("B|BANK|"), F.col(line) if isinstance(line, str) else line)


def _named_money(c: str) -> Column:
    return money(F.col(c), F.col("currency"))


def settlement_failures(rows: DataFrame) -> Found:
    """rows: batch_id, currency, net, settlement_date, status, rule, amount, text -> state and exception each."""
    key = stl_key("batch_id")
    state = shaped(rows, STATE, chain="B", record_type="settlement", record_id=F.col("batch_id"), amount_minor=F.col("net"),
                   case_key=key, detail=F.col("text"))
    case = shaped(rows, EXCEPTION, chain="B", case_key=key, case_type=F.col("status"), anchor_type="settlement",
                  anchor_id=F.col("batch_id"), amount_minor=F.col("amount"), anchor_date=F.col("settlement_date"),
                  explanation=F.col("text"))
    return Found([state], [case], [], [], [])


def line_failures(rows: DataFrame) -> Found:
    """rows: bank_id, currency, amount, value_date, status, rule, text -> state and exception of the line itself."""
    key = bank_key("bank_id")
    state = shaped(rows, STATE, chain="B", record_type="bank", record_id=F.col("bank_id"), amount_minor=F.col("amount"),
                   case_key=key, detail=F.col("text"))
    case = shaped(rows, EXCEPTION, chain="B", case_key=key, case_type=F.col("status"), anchor_type="bank",
                  anchor_id=F.col("bank_id"), amount_minor=F.col("amount"), anchor_date=F.col("value_date"),
                  explanation=F.col("text"))
    own = shaped(rows, EVIDENCE, case_key=key, record_type="bank", record_id=F.col("bank_id"), role="bank")
    return Found([state], [case], [], [], [own])


def line_states(rows: DataFrame) -> DataFrame:
    """rows: bank_id, currency, amount, status, rule, claimed_by (a batch) -> states that point to the batch's case."""
    return shaped(rows, STATE, chain="B", record_type="bank", record_id=F.col("bank_id"), amount_minor=F.col("amount"),
                  case_key=stl_key("claimed_by"), detail=F.concat(F.lit("See the case of settlement "), F.col("claimed_by")))


def matches(groups: DataFrame, left: DataFrame, right: DataFrame) -> Found:
    """groups: group_key, rule, currency, phase, keys, text; left (group_key, batch_id, net), right (group_key,
    bank_id, amount) with currency and rule."""
    states = [
        shaped(left, STATE, chain="B", record_type="settlement", record_id=F.col("batch_id"), amount_minor=F.col("net"), status="MATCHED"),
        shaped(right, STATE, chain="B", record_type="bank", record_id=F.col("bank_id"), amount_minor=F.col("amount"), status="MATCHED"),
    ]
    members = [
        shaped(left, MEMBER, side="L", record_type="settlement", record_id=F.col("batch_id"), amount_minor=F.col("net")),
        shaped(right, MEMBER, side="R", record_type="bank", record_id=F.col("bank_id"), amount_minor=F.col("amount")),
    ]
    return Found(states, [], [shaped(groups, GROUP, chain="B", explanation=F.col("text"))], members, [])


def subset_sums(amounts: Column, most: int) -> Column:
    """array<struct<n, s, at>>: size, sum and positions of all subsets of up to ``most`` of the amounts."""
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("s"), F.array().cast("array<int>").alias("at")))
    start = F.struct(F.lit(0).alias("i"), none.alias("sets"))

    def step(state: Column, amount: Column) -> Column:
        room = F.filter(state["sets"], lambda x: x["n"] < most)
        more = F.transform(room, lambda x: F.struct((x["n"] + 1).alias("n"), (x["s"] + amount).alias("s"), F.concat(x["at"], F.array(state["i"])).alias("at")))
        return F.struct((state["i"] + 1).alias("i"), F.concat(state["sets"], more).alias("sets"))

    return F.aggregate(amounts, start, step, lambda s: s["sets"])


def in_window(rules: Rules) -> Column:
    return F.datediff("value_date", "settlement_date").between(-rules.window_before, rules.window_after)


def unsettled(psp: DataFrame, as_of: date, rules: Rules) -> Found:
    """Items in no batch: not due within the grace after they became available, overdue afterwards."""
    waits = F.datediff(F.lit(as_of), F.col("available_on"))
    due = waits <= rules.unsettled_grace
    key = F.concat(F.lit("B|ITEM|"), F.col("record_id"))
    text = F.concat(F.lit("Provider item "), F.col("record_id"), F.lit(" of net "), _named_money("net_minor"), F.lit(" is in no settlement batch "),
                    waits.cast("string"), F.lit(" days after it became available."))
    items = psp.where("batch_id IS NULL").withColumns({"text": text, "due": due, "key": key})
    late = items.where(~due)
    state = shaped(items, STATE, chain="B", record_type="psp", amount_minor=F.col("net_minor"), detail=F.col("text"),
                   status=F.when(F.col("due"), "NOT_DUE").otherwise("UNSETTLED_OVERDUE"),
                   rule=F.when(F.col("due"), "B-T1_NOT_DUE").otherwise("B-X1_UNSETTLED"), case_key=F.when(~F.col("due"), F.col("key")))
    case = shaped(late, EXCEPTION, chain="B", case_key=F.col("key"), case_type="UNSETTLED_OVERDUE", rule="B-X1_UNSETTLED", anchor_type="psp",
                  anchor_id=F.col("record_id"), amount_minor=F.col("net_minor"), anchor_date=F.col("available_on"), explanation=F.col("text"))
    own = shaped(late, EVIDENCE, case_key=F.col("key"), record_type="psp", role="psp")
    return Found([state], [case], [], [], [own])


def reference_links(lines: DataFrame, settlements: DataFrame) -> DataFrame:
    """(bank_id, batch_id): a whole token of the line's reference names the batch, whatever the case."""
    tokens = lines.select("bank_id", F.explode(reference_tokens(F.col("reference"))).alias("token"))
    named = settlements.select("batch_id", F.upper("batch_id").alias("token"))
    return tokens.join(named, "token").select("bank_id", "batch_id").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (bank_id, batch_id) -> with ``comp``. Stars need no search: a batch whose lines name it alone, or a line
    whose batches have no other line; only what is left goes through the component rounds."""
    degrees = links.join(links.groupBy("batch_id").agg(F.count("*").alias("lines")), "batch_id").join(
        links.groupBy("bank_id").agg(F.count("*").alias("batches")), "bank_id"
    )
    of_batch = degrees.groupBy("batch_id").agg(F.max("batches").alias("most_batches"))
    of_line = degrees.groupBy("bank_id").agg(F.max("lines").alias("most_lines"))
    marked = settle(degrees.join(of_batch, "batch_id").join(of_line, "bank_id"), "links")
    star = F.when(F.col("most_batches") == 1, F.concat(F.lit("S:"), F.col("batch_id"))).when(
        F.col("most_lines") == 1, F.concat(F.lit("K:"), F.col("bank_id"))
    )
    stars = marked.where(star.isNotNull()).select("bank_id", "batch_id", star.alias("comp"))
    rest = marked.where(star.isNull()).select("bank_id", "batch_id")
    root = roots(rest.select(F.concat(F.lit("S:"), "batch_id").alias("u"), F.concat(F.lit("K:"), "bank_id").alias("v")))
    named = rest.withColumn("u", F.concat(F.lit("S:"), "batch_id")).join(root, "u", "left")
    return stars.unionByName(named.select("bank_id", "batch_id", F.coalesce("v", "u").alias("comp")))


def _competing(lines: DataFrame, rules: Rules) -> DataFrame:
    """lines of single-batch components (comp, bank_id, amount, net, inside, exact) -> comps in which lines other
    than the exact one, the first ones by id, add up to the net as well."""
    first = W.partitionBy("comp").orderBy("bank_id")
    few = lines.where("inside AND NOT exact").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= rules.max_candidates)
    sums = few.groupBy("comp").agg(F.min("net").alias("net"), F.collect_list("amount").alias("amounts"))
    hit = F.exists(subset_sums(F.col("amounts"), rules.max_ref_group), lambda x: (x["n"] >= 2) & (x["s"] == F.col("net")))
    return sums.where(hit).select("comp", F.lit(True).alias("competing"))


def by_reference(linked: DataFrame, rules: Rules) -> tuple[Found, DataFrame, DataFrame]:
    """linked: comp, batch and line columns of every link of a good settlement with a free line -> what was found, and
    the settlements and lines that it decides."""
    batches = linked.select("comp", "batch_id", *(F.col(c).alias(f"s_{c}") for c in ACCOUNT), "net", "settlement_date").distinct()
    lines = linked.select("comp", "bank_id", *(F.col(f"k_{c}") for c in ACCOUNT), "amount", "value_date").distinct()
    batches, lines = settle_all((batches, "batches"), (lines, "named-lines"))
    places = batches.select("comp", F.col("s_bank_account").alias("a"), F.col("s_currency").alias("c")).unionByName(
        lines.select("comp", F.col("k_bank_account").alias("a"), F.col("k_currency").alias("c"))
    )
    inside = in_window(rules)
    shape = (
        batches.groupBy("comp").agg(F.count("*").alias("n_s"), F.sum("net").alias("net_sum"), F.min("batch_id").alias("first_batch"))
        .join(lines.groupBy("comp").agg(
            F.count("*").alias("n_k"), F.sum("amount").alias("total"), F.min("bank_id").alias("first_line"),
            F.collect_set("k_currency").alias("line_currencies")), "comp")
        .join(places.groupBy("comp").agg((F.count_distinct("a", "c") > 1).alias("cross")), "comp")
        .join(linked.groupBy("comp").agg(
            F.count_if((F.col("amount") == F.col("net")) & inside).alias("exact"), F.every(inside).alias("all_in"),
            F.every((F.col("amount") > 0) == (F.col("net") > 0)).alias("same_sign")), "comp")
    )
    single = linked.withColumns({"inside": inside, "exact": (F.col("amount") == F.col("net")) & inside})
    lone = shape.where("n_s = 1 AND exact = 1 AND NOT cross").select("comp")
    shape = shape.join(_competing(single.join(lone, "comp"), rules), "comp", "left")
    size = F.greatest("n_s", "n_k")
    conserves = (F.col("net_sum") == F.col("total")) & F.col("all_in")
    one, line = F.col("n_s") == 1, F.col("n_k") == 1
    verdict = (
        F.when(F.col("cross"), "cross")
        .when(one & (F.col("exact") == 1) & F.col("competing"), "competing")
        .when(one & (F.col("exact") == 1), "b1")
        .when(one & (F.col("exact") > 1), "several")
        .when(one & conserves & (F.col("n_k") > 1) & (size <= rules.max_ref_group), "split")
        .when(one & (F.col("net_sum") == F.col("total")) & ~F.col("all_in"), "date")
        .when(one & F.col("same_sign") & (F.abs("total") < F.abs("net_sum")), "partial")
        .when(one, "amount")
        .when(line & conserves & (size <= rules.max_ref_group), "merged")
        .when(line, "group")
        .otherwise("complex")
    )
    shape = settle(shape.withColumn("verdict", verdict), "shapes")
    return _referenced(shape, single, batches, lines), batches, lines


#: verdict -> (rule, status of the lines)
_RULE = {
    "cross": ("B-X7_ACCOUNT_OR_CURRENCY", "HELD_FOR_REVIEW", "referencing_line"),
    "competing": ("B-X4_AMBIGUOUS", "AMBIGUOUS", "candidate"),
    "several": ("B-X4_AMBIGUOUS", "AMBIGUOUS", "candidate"),
    "date": ("B-X9_DATE", "HELD_FOR_REVIEW", "referencing_line"),
    "partial": ("B-X10_PARTIAL", "HELD_FOR_REVIEW", "partial_receipt"),
    "amount": ("B-X11_REF_AMOUNT", "HELD_FOR_REVIEW", "referencing_line"),
    "group": ("B-X12_REF_GROUP", "HELD_FOR_REVIEW", "referencing_line"),
    "complex": ("B-X13_COMPLEX", "HELD_FOR_REVIEW", "referencing_line"),
}


def _lookup(column: str, at: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in _RULE.items() for x in (k, v[at])])[F.col(column)]


def _failed(shape: DataFrame, batches: DataFrame) -> DataFrame:
    """The settlements of components that don't match, with status, amount and text."""
    v = F.col("verdict")
    other_currency = F.size(F.array_remove(F.col("line_currencies"), F.col("s_currency"))) > 0
    status = (
        F.when((v == "cross") & other_currency, "CURRENCY_MISMATCH")
        .when(v == "cross", "ACCOUNT_MISMATCH")
        .when(v.isin("competing", "several"), "AMBIGUOUS_CANDIDATES")
        .when(v == "date", "DATE_OUT_OF_WINDOW")
        .when(v == "partial", "PARTIAL_RECEIPT")
        .when(v == "complex", "COMPLEX_REFERENCE")
        .when((v == "group") & (F.col("net_sum") == F.col("total")), "DATE_OUT_OF_WINDOW")
        .otherwise("AMOUNT_MISMATCH")
    )
    amount = (
        F.when(v.isin("partial", "amount"), F.col("net") - F.col("total"))
        .when(v == "group", F.col("net_sum") - F.col("total"))
        .otherwise(F.col("net"))
    )
    named = money(F.col("net"), F.col("s_currency"))
    text = F.concat(
        F.lit("Settlement "), F.col("batch_id"), F.lit(" of net "), named, F.lit(" is named by "), F.col("n_k").cast("string"),
        F.lit(" bank line(s) of total "), money(F.col("total"), F.col("s_currency")), F.lit(" together with "),
        (F.col("n_s") - 1).cast("string"), F.lit(" other settlement(s): "),
        F.when(v == "cross", "accounts or currencies differ.").when(v == "competing", "two explanations compete.")
        .when(v == "several", "several lines carry the exact net.").when(v == "date", "a value date is outside the window.")
        .when(v == "partial", "part of the net is outstanding.").when(v == "complex", "links are many to many.")
        .otherwise("the amounts or dates do not fit."),
    )
    failed = shape.where(v.isin(*_RULE)).join(batches, "comp")
    return failed.withColumns({"status": status, "amount": amount, "text": text, "rule": _lookup("verdict", 0), "currency": F.col("s_currency")})


def _referenced(shape: DataFrame, single: DataFrame, batches: DataFrame, lines: DataFrame) -> Found:
    """Matches, failures and evidence of the judged components."""
    bad = shape.where(F.col("verdict").isin(*_RULE))
    good = shape.where(F.col("verdict").isin("b1", "split", "merged"))
    rule = F.when(F.col("verdict") == "b1", "B1_REF_1TO1").when(F.col("verdict") == "split", "B2S_REF_SPLIT").otherwise("B2M_REF_MERGED")
    good = good.withColumns({"rule": rule, "group_key": F.concat(F.lit("B|"), F.col("comp"))})
    head = good.select("comp", "verdict", "rule", "group_key", F.col("first_batch").alias("batch_id"))
    held = bad.select("comp", "verdict", "first_batch", "first_line", "n_s").join(lines, "comp").withColumns({
        "status": _lookup("verdict", 1), "rule": _lookup("verdict", 0), "currency": F.col("k_currency"), "claimed_by": F.col("first_batch"),
    })
    # a merged line is linked once to each of its settlements
    exact = single.where("exact").select("comp", "bank_id", F.lit(True).alias("exact")).distinct()
    named = head.join(lines, "comp").join(exact, ["comp", "bank_id"], "left").withColumn("currency", F.col("k_currency"))
    failed, held, left, named = settle_all(
        (_failed(shape, batches), "failed"), (held, "held"),
        (head.drop("batch_id").join(batches, "comp").withColumn("currency", F.col("s_currency")), "left"), (named, "named"),
    )
    out = settlement_failures(failed)
    out.states.append(line_states(held))
    # a lone settlement's lines are its own; those of several settlements are a class
    class_key = F.concat(F.lit("R|"), F.col("first_line"))
    role = {"role": _lookup("verdict", 2)}
    out.evidence.append(shaped(held.where("n_s = 1"), EVIDENCE, case_key=stl_key("first_batch"), record_type="bank", record_id=F.col("bank_id"), **role))
    out.evidence.append(shaped(failed.where("n_s > 1"), EVIDENCE, case_key=stl_key("batch_id"), record_type="class", record_id=class_key, members=F.col("n_k"), **role))
    out.classes.append(shaped(held.where("n_s > 1"), CLASS, class_key=class_key, record_type="bank", record_id=F.col("bank_id")))

    keys = left.groupBy("comp").agg(F.sort_array(F.collect_list("batch_id")).alias("first_key"), F.min("currency").alias("currency"))
    text = F.concat(F.lit("References name "), F.array_join("first_key", ", "), F.lit("; net and bank amount conserve within the window."))
    # no settlement is in two groups, so the first key decides their order
    groups = good.join(keys, "comp").withColumns({"phase": F.lit(1), "second_key": F.array().cast("array<string>"), "text": text})
    out.add(matches(groups, left, named.where("verdict <> 'b1' OR exact")))
    why = F.concat(F.lit("Bank line "), F.col("bank_id"), F.lit(" also names "), F.col("batch_id"), F.lit(", which is matched in full; possibly paid twice."))
    extra = named.where("verdict = 'b1' AND exact IS NULL").withColumns({"status": F.lit("DUPLICATE_REFERENCE_CREDIT"), "rule": F.lit("B-X8_DUP_REF"), "text": why})
    more = line_failures(extra)
    more.evidence.append(shaped(extra, EVIDENCE, case_key=bank_key("bank_id"), record_type="settlement", record_id=F.col("batch_id"), role="referenced"))
    out.add(more)
    return out


def by_amount(free_s: DataFrame, free_k: DataFrame, rules: Rules) -> tuple[Found, DataFrame, DataFrame]:
    """Equal amount in the window, unique on both sides; the rest of such candidates is ambiguous. What was found, and the
    settlements and lines that it decides."""
    key = [*ACCOUNT, "minor"]
    s = free_s.withColumn("minor", F.col("net"))
    k = free_k.withColumn("minor", F.col("amount"))
    k_days = k.groupBy(*key, F.col("value_date").alias("day")).agg(F.count("*").alias("n"), F.min("bank_id").alias("least"))
    s_days = s.groupBy(*key, F.col("settlement_date").alias("day")).agg(F.count("*").alias("n"), F.min("batch_id").alias("least"))
    spread = lambda df, c, a, b: df.withColumn("day", F.explode(F.sequence(F.date_add(c, a), F.date_add(c, b))))
    degree = lambda df, days, ident: df.join(days, [*key, "day"]).groupBy(ident).agg(F.sum("n").alias("degree"), F.min("least").alias("other"))
    s_deg = degree(spread(s, "settlement_date", -rules.window_before, rules.window_after), k_days, "batch_id")
    k_deg = degree(spread(k, "value_date", -rules.window_after, rules.window_before), s_days, "bank_id")
    of_s, of_k = settle_all(
        (s.join(s_deg, "batch_id").withColumnRenamed("other", "bank_id"), "amount-s"),
        (k.join(k_deg, "bank_id").withColumnRenamed("other", "claimed_by"), "amount-k"),
    )
    lone = of_k.where("degree = 1").select("bank_id", "amount", "value_date", F.lit(True).alias("lone"))
    paired = of_s.where("degree = 1").join(lone, "bank_id")
    rule = "B3_AMOUNT_DATE_UNIQUE"
    pair = paired.withColumns({"group_key": F.concat(F.lit("B|U:"), F.col("bank_id")), "rule": F.lit(rule)})
    pair = settle(pair, "pair")
    text = F.concat(F.lit("Net "), _named_money("net"), F.lit(" of "), F.col("batch_id"), F.lit(" and bank line "), F.col("bank_id"),
                    F.lit(" are the only candidates for each other in the window."))
    groups = pair.withColumns({"phase": F.lit(2), "first_key": F.array("bank_id"), "second_key": F.array("batch_id"), "text": text})
    out = matches(groups, pair, pair)
    unsure = of_s.join(pair.select("batch_id"), "batch_id", "left_anti").withColumns({
        "status": F.lit("AMBIGUOUS_CANDIDATES"), "rule": F.lit("B-X4_AMBIGUOUS"), "amount": F.col("net"),
        "text": F.concat(F.lit("Settlement "), F.col("batch_id"), F.lit(" of net "), _named_money("net"), F.lit(" has "),
                         F.col("degree").cast("string"), F.lit(" bank line(s) of its amount in the window, and they or it have other candidates.")),
    })
    lines = of_k.join(pair.select("bank_id"), "bank_id", "left_anti").withColumns({"status": F.lit("AMBIGUOUS"), "rule": F.lit("B-X4_AMBIGUOUS")})
    unsure, lines = settle_all((unsure, "unsure"), (lines, "unsure-lines"))
    out.add(settlement_failures(unsure))
    out.states.append(line_states(lines))
    # the equal lines of a day are a class: as evidence there are at most as many as the window has days
    class_key = F.concat_ws("|", F.lit("U"), *key, F.col("day").cast("string"))
    shown = spread(unsure, "settlement_date", -rules.window_before, rules.window_after).select(*key, "day", "batch_id").join(k_days, [*key, "day"])
    out.evidence.append(shaped(shown, EVIDENCE, case_key=stl_key("batch_id"), record_type="class", record_id=class_key, role="candidate", members=F.col("n")))
    listed = lines.withColumn("day", F.col("value_date"))
    out.classes.append(shaped(listed, CLASS, class_key=class_key, record_type="bank", record_id=F.col("bank_id")))
    return out, of_s, of_k


def _suggestions(wholes: DataFrame, parts: DataFrame, before: int, after: int, rules: Rules) -> DataFrame:
    """wholes and parts (id, account, currency, minor, day) -> (id, many, sets): sets of 2.. parts, positions in the
    sorted candidate ids, that add up to the whole; ``many`` if there are too many candidates to look at.

    Of each account, day and sign the parts of least size are kept, one more than may be looked at: if that many are
    too many, so are all.
    """
    place = [*ACCOUNT, "sign"]
    signed = lambda df: df.withColumn("sign", F.col("minor") > 0)
    small = W.partitionBy(*place, "day").orderBy(F.abs("minor"), "id")
    few = signed(parts).withColumn("nth", F.row_number().over(small)).where(F.col("nth") <= rules.max_candidates + 1)
    days = few.groupBy(*place, "day").agg(F.collect_list(F.struct(F.col("id").alias("part"), F.col("minor").alias("value"))).alias("parts"))
    spread = signed(wholes).withColumn("day", F.explode(F.sequence(F.date_add("day", before), F.date_add("day", after))))
    near = F.filter("parts", lambda p: F.abs(p["value"]) < F.abs(F.col("minor")))
    met = spread.join(days, [*place, "day"]).select("id", "minor", near.alias("near"))
    cands = met.groupBy("id", "minor").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("cands")).where(F.size("cands") > 1)
    sums = subset_sums(F.transform(F.slice("cands", 1, rules.max_candidates), lambda c: c["value"]), rules.max_suggested)
    hits = F.filter(sums, lambda x: (x["n"] >= 2) & (x["s"] == F.col("minor")))
    many = F.size("cands") > rules.max_candidates
    return cands.select("id", many.alias("many"), F.transform("cands", lambda c: c["part"]).alias("parts"),
                        F.when(~many, hits).otherwise(F.slice(hits, 1, 0)).alias("hits"))


def suggest(free_s: DataFrame, free_k: DataFrame, rules: Rules) -> tuple[Found, DataFrame, DataFrame, DataFrame]:
    """Groups of 2 to 4 on one side that add up to one record of the other, for review only; the settlements and lines
    that this decides; and the lines that were skipped because they have too many candidates."""
    s = free_s.select(F.col("batch_id").alias("id"), *ACCOUNT, F.col("net").alias("minor"), F.col("settlement_date").alias("day"))
    k = free_k.select(F.col("bank_id").alias("id"), *ACCOUNT, F.col("amount").alias("minor"), F.col("value_date").alias("day"))
    merged = _suggestions(k, s, -rules.window_after, rules.window_before, rules)
    split = _suggestions(s, k, -rules.window_before, rules.window_after, rules)
    opened = lambda df, shape: df.select("id", "parts", F.explode("hits").alias("h")).select(
        F.struct(F.lit(shape).alias("shape"), F.col("id").alias("id"), F.col("h.n").alias("n"), F.col("h.at").alias("at")).alias("place"),
        F.transform("h.at", lambda i: F.element_at("parts", i + 1)).alias("several"), F.col("id").alias("whole"),
    )
    found, capped = settle_all((
        opened(merged, 0).select("place", F.col("several").alias("batches"), F.array("whole").alias("lines"))
        .unionByName(opened(split, 1).select("place", F.array("whole").alias("batches"), F.col("several").alias("lines"))),
        "suggestions"), (merged.where("many").select(F.col("id").alias("bank_id")), "capped"),
    )
    member = found.select("place", F.explode(F.concat(
        F.transform("batches", lambda x: F.struct(F.lit("S").alias("side"), x.alias("id"))),
        F.transform("lines", lambda x: F.struct(F.lit("K").alias("side"), x.alias("id"))))).alias("m")).select("place", "m.*")
    usage = settle(member.groupBy("side", "id").agg(F.count("*").alias("uses"), F.min("place").alias("first")), "usage")
    contested = member.join(usage, ["side", "id"]).groupBy("place").agg((F.max("uses") > 1).alias("contested"))
    first_s = usage.where("side = 'S'").select(F.col("id").alias("batch_id"), F.col("first").alias("place"))
    told = first_s.join(found, "place").join(contested, "place").join(free_s, "batch_id").withColumns({
        "status": F.when(F.col("contested"), "AMBIGUOUS_CANDIDATES").otherwise("SUGGESTED_GROUP"),
        "rule": F.lit("B4_AMOUNT_GROUP_SUGGESTION"), "amount": F.col("net"),
        "text": F.concat(F.lit("Settlements "), F.array_join("batches", " + "), F.lit(" add up to bank lines "), F.array_join("lines", " + "),
                         F.lit(" by amount alone; a suggestion for review.")),
    })
    # a line's case is that of the first settlement which its own first suggestion decided, or else of the first one
    decided = first_s.groupBy("place").agg(F.min("batch_id").alias("decided"))
    lines = (
        usage.where("side = 'K'").select(F.col("id").alias("bank_id"), F.col("first").alias("place"))
        .join(found, "place").join(decided, "place", "left").join(free_k, "bank_id")
        .withColumns({"claimed_by": F.coalesce("decided", F.element_at("batches", 1)), "status": F.lit("SUGGESTED"), "rule": F.lit("B4_AMOUNT_GROUP_SUGGESTION")})
    )
    told, lines = settle_all((told, "told"), (lines, "suggested-lines"))
    out = settlement_failures(told)
    out.evidence.append(shaped(told.select("batch_id", F.explode("lines").alias("line")), EVIDENCE, case_key=stl_key("batch_id"),
                               record_type="bank", record_id=F.col("line"), role="suggested_counterpart"))
    out.states.append(line_states(lines))
    return out, told, lines, capped


def leftovers(free_s: DataFrame, free_k: DataFrame, capped: DataFrame, as_of: date, rules: Rules) -> Found:
    """Settlements without a line are in transit or missing; lines without a settlement are unexpected."""
    waits = F.datediff(F.lit(as_of), F.col("settlement_date"))
    fresh = waits <= rules.window_after
    moving = shaped(free_s.where(fresh), STATE, chain="B", record_type="settlement", record_id=F.col("batch_id"), amount_minor=F.col("net"),
                    status="IN_TRANSIT", rule="B-T2_IN_TRANSIT", detail="No bank line yet; the window is still open.")
    gone = free_s.where(~fresh).withColumns({
        "status": F.lit("MISSING_IN_BANK"), "rule": F.lit("B-X5_NO_BANK"), "amount": F.col("net"),
        "text": F.concat(F.lit("Settlement "), F.col("batch_id"), F.lit(" of net "), _named_money("net"), F.lit(" has no bank line "),
                         waits.cast("string"), F.lit(" days after its date.")),
    })
    out = settlement_failures(gone)
    out.states.append(moving)
    note = F.when(F.col("capped"), F.lit(" Amount groups were not searched: too many candidates.")).otherwise("")
    lines = free_k.join(capped.withColumn("capped", F.lit(True)), "bank_id", "left").withColumns({
        "status": F.when(F.col("amount") > 0, "UNEXPECTED_BANK_CREDIT").otherwise("UNEXPECTED_BANK_DEBIT"),
        "rule": F.lit("B-X6_NO_SETTLEMENT"),
        "text": F.concat(F.lit("Bank line "), F.col("bank_id"), F.lit(" of "), _named_money("amount"), F.lit(" has no settlement."), note),
    })
    out.add(line_failures(lines))
    return out


def _free(free_s: DataFrame, free_k: DataFrame, of_s: DataFrame, of_k: DataFrame) -> list[DataFrame]:
    """The settlements and lines that a phase has not decided."""
    return settle_all(
        (free_s.join(of_s.select("batch_id"), "batch_id", "left_anti"), "free-s"),
        (free_k.join(of_k.select("bank_id"), "bank_id", "left_anti"), "free-k"),
    )


def chain_b(psp: DataFrame, bank: DataFrame, settlements: DataFrame, blocked: DataFrame, as_of: date, rules: Rules = Rules()) -> Found:
    out = unsettled(psp, as_of, rules)
    every = bank.withColumnRenamed("record_id", "bank_id").withColumnRenamed("amount_minor", "amount")
    bad = blocked.where("source = 'bank'").select(F.col("record_id").alias("bank_id"), "issue_ids")
    stopped = every.join(bad, "bank_id").withColumns({
        "status": F.lit("SOURCE_CONFLICT"), "rule": F.lit("B-X2_CONFLICT"),
        "text": F.concat(F.lit("Source rows of bank line "), F.col("bank_id"), F.lit(" conflict; blocked.")),
    })
    out.add(line_failures(stopped))
    out.evidence.append(shaped(stopped.select("bank_id", F.explode("issue_ids").alias("i")), EVIDENCE, case_key=bank_key("bank_id"),
                               record_type="row_issue", record_id=F.col("i").cast("string"), role="conflicting_row"))
    lines = settle(every.join(bad, "bank_id", "left_anti"), "lines")
    links = settle(reference_links(lines, settlements), "reference-links")

    broken = settlements.where("problem IS NOT NULL").withColumns({
        "status": F.col("problem"), "rule": F.lit("B-X3_BATCH_PROBLEM"), "amount": F.col("net"),
        "text": F.concat(F.lit("Settlement "), F.col("batch_id"), F.lit(" cannot be matched: "), F.col("problem")),
    })
    out.add(settlement_failures(broken))
    to_broken = links.join(broken.select("batch_id"), "batch_id")
    to_broken = settle(to_broken, "broken-links")
    claims = to_broken.groupBy("bank_id").agg(F.min("batch_id").alias("claimed_by"))
    held = lines.join(claims, "bank_id").withColumns({"status": F.lit("HELD_FOR_REVIEW"), "rule": F.lit("B-X3_BATCH_PROBLEM")})
    out.states.append(line_states(held))
    out.evidence.append(shaped(to_broken, EVIDENCE, case_key=stl_key("batch_id"), record_type="bank", record_id=F.col("bank_id"), role="referencing_line"))

    good = settlements.where("problem IS NULL")
    usable = links.join(claims, "bank_id", "left_anti").join(good.select("batch_id"), "batch_id")
    of_line = lines.select("bank_id", *(F.col(c).alias(f"k_{c}") for c in ACCOUNT), "amount", "value_date")
    linked = components(usable).join(good, "batch_id").join(of_line, "bank_id")
    named, of_s, of_k = by_reference(settle(linked, "linked"), rules)
    out.add(named)
    free_s, free_k = _free(good, lines.join(claims, "bank_id", "left_anti"), of_s, of_k)
    equal, of_s, of_k = by_amount(free_s, free_k, rules)
    out.add(equal)
    free_s, free_k = _free(free_s, free_k, of_s, of_k)
    offered, of_s, of_k, capped = suggest(free_s, free_k, rules)
    out.add(offered)
    out.add(leftovers(*_free(free_s, free_k, of_s, of_k), capped, as_of, rules))
    items = psp.where("batch_id IS NOT NULL").select(F.col("record_id"), stl_key("batch_id").alias("case_key"))
    stl_cases = settlements.select("batch_id", stl_key("batch_id").alias("case_key"))
    open_cases = out.exceptions[0].select("case_key")
    for e in out.exceptions[1:]:
        open_cases = open_cases.unionByName(e.select("case_key"))
    out.evidence.append(shaped(stl_cases.join(open_cases, "case_key", "left_semi"), EVIDENCE, record_type="settlement", record_id=F.col("batch_id"), role="settlement"))
    out.evidence.append(shaped(items.join(open_cases, "case_key", "left_semi"), EVIDENCE, record_type="psp", role="settlement_item"))
    return out
