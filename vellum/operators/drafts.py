"""Invoice drafts from the JSON of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.numbers import parse_decimal, within_tolerance
from vellum.functions.scan import let
from vellum.functions.text import optional_text, read_text

TEXTS = ("supplier_name", "supplier_tax_id", "invoice_number", "invoice_date", "customer_code", "customer_name", "currency")
NUMBERS = ("taxable_base", "tax_rate", "tax_amount", "invoice_total")
REQUIRED = ("supplier_name", "invoice_number", "invoice_date", "customer_code", "customer_name", *NUMBERS)

# Other names of keys, in order; one counts only where the canonical key is absent.
PAGE_ALIASES = {"line_items": ["lines"], "supplier_name": ["provider", "supplier", "provider_name"], "taxable_base": ["subtotal"], "invoice_total": ["total"], "tax_amount": ["vat_amount"]}
LINE_ALIASES = {"description": ["service"], "project_reference": ["project", "reference", "project_ref", "project_code"]}
TAX_ALIASES = {"rate": ["tax_rate"], "taxable_base": ["base"], "amount": ["tax_amount"]}


KEYS = "map<string,string>"
#: Raw text counts only as JSON proper.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _fields(keys: Column, names: tuple[str, ...], aliases: dict[str, list[str]]) -> dict[str, Column]:
    """Each field as text from a map of keys: of the canonical key if present, null or not,
    else of its first alias present.  Nested values are raw JSON."""
    out = {}
    for name in names:
        *first, last = [name, *aliases.get(name, [])]
        value = F.try_element_at(keys, F.lit(last))
        for key in reversed(first):  # whether a key is there is only asked where it has no value
            value = F.coalesce(F.try_element_at(keys, F.lit(key)), F.when(~F.map_contains_key(keys, key), value))
        out[name] = value
    return out


def parse_payload(payloads: DataFrame) -> DataFrame:
    """One row a page: its fields as text, its items as raw JSON, and the page's warnings.

    The payload counts, else the raw text if that is a JSON object; other raw text warns
    and makes an empty page.  Unknown keys are ignored.
    """
    raw = F.col("raw_text")
    decoded = F.when(F.col("payload").isNull() & F.trim(raw).startswith("{"), F.from_json(raw, KEYS, _STRICT))
    rows = payloads.withColumn("keys", F.coalesce(F.from_json("payload", KEYS), decoded))
    bad = F.col("payload").isNull() & (F.coalesce(raw, F.lit("")) != "") & F.col("keys").isNull() & F.try_parse_json(raw).isNull()
    page = F.col("page_no").cast("string")
    none = F.array().cast("array<string>")
    warnings = F.concat(
        F.transform(F.filter(F.coalesce("errors", none), lambda e: e != ""), lambda e: F.concat(F.lit("Página "), page, F.lit(": "), e)),
        F.when(bad, F.array(F.concat(F.lit("Página "), page, F.lit(": Docling no devolvió JSON válido.")))).otherwise(none),
    )
    warnings = F.when((F.size("errors") > 0) | bad, warnings).otherwise(none)
    rows = rows.withColumn("page_warnings", warnings)
    fields = _fields(F.col("keys"), (*TEXTS, *NUMBERS, "line_items", "taxes"), PAGE_ALIASES)
    status = ["status"] if "status" in payloads.columns else []
    rows = rows.select("doc_id", "page_no", "page_warnings", *status, *[c.alias(n) for n, c in fields.items()])
    return rows.withColumns({n: read_text(F.col(n)) for n in TEXTS})


def _page_struct() -> Column:
    """A page: its texts, its numbers, and which of those are printed but are no numbers."""
    bad = [(F.col(f"n{i}").isNull() & F.col(f"s{i}").isNotNull()).cast("int").alias(f"bad_{n}") for i, n in enumerate(NUMBERS)]
    return F.struct("page_no", "page_warnings", *TEXTS, *[F.col(f"n{i}").alias(n) for i, n in enumerate(NUMBERS)], *bad)


def _value(pages: Column, name: str) -> Column:
    """The first value of a field over the pages of a document, which are in order; most often the first page has it."""
    return F.coalesce(F.get(pages[name], 0), F.when(F.size(pages) > 1, F.get(F.array_compact(pages[name]), 0)))


def _clash(pages: Column, name: str) -> Column:
    """What contradicts on the pages; values are only listed where the least and the greatest differ."""

    def of(own: Column) -> Column:
        listed = F.array_join(F.transform(own, lambda x: F.format_string("p.%d: %s", x["page_no"], x["value"].cast("string"))), ", ")
        differ = F.size(F.array_distinct(F.transform(own, lambda x: F.lower(x["value"]) if name in TEXTS else x["value"]))) > 1
        return F.when(differ, F.concat(F.lit(f"Valores contradictorios para {name}: "), listed, F.lit(".")))

    own = F.filter(F.transform(pages, lambda p: F.struct(p["page_no"].alias("page_no"), p[name].alias("value"))), lambda x: x["value"].isNotNull())
    return F.when(F.array_min(pages[name]) != F.array_max(pages[name]), let(own, of))


def _bad(pages: Column, name: str) -> Column:
    if name in TEXTS:
        return F.lit(0).cast("long")
    return F.aggregate(pages[f"bad_{name}"], F.lit(0).cast("long"), lambda acc, bad: acc + bad)


def _gather(pages: DataFrame) -> DataFrame:
    """One row a document with its pages in order."""
    return _parsed(pages, [F.col(n) for n in NUMBERS]).groupBy("doc_id").agg(F.sort_array(F.collect_list(_page_struct())).alias("held"))


def _header_rows(pages: DataFrame, names: tuple[str, ...]) -> DataFrame:
    held = F.col("held")
    rows = F.array(*[F.struct(F.lit(n).alias("field"), _value(held, n).cast("string").alias("value"), _clash(held, n).alias("warning"), _bad(held, n).alias("bad")) for n in names])
    return _gather(pages).select("doc_id", F.explode(rows).alias("f")).select("doc_id", "f.*")


def header_text(pages: DataFrame) -> DataFrame:
    """``doc_id, field, value, warning, bad``: the first page's value, and contradictions whatever the case."""
    return _header_rows(pages, TEXTS)


def header_decimal(pages: DataFrame) -> DataFrame:
    """The same of numbers; ``bad`` counts the pages whose value is no number."""
    return _header_rows(pages, NUMBERS)


def _items(pages: DataFrame, column: str) -> DataFrame:
    items = pages.select("doc_id", "page_no", F.posexplode_outer(F.from_json(column, "array<string>")).alias("at", "item")).where("at is not null")
    return items.withColumn("keys", F.from_json("item", KEYS))


_LINE_TEXTS, _LINE_NUMBERS, _TAX_NUMBERS = ("description", "user", "project_reference"), ("quantity", "unit_price", "amount"), ("rate", "taxable_base", "amount")


def _line_fields(keys: Column) -> dict[str, Column]:
    return _fields(keys, (*_LINE_TEXTS, *_LINE_NUMBERS), LINE_ALIASES)


def _tax_fields(keys: Column) -> dict[str, Column]:
    return _fields(keys, ("tax_type", *_TAX_NUMBERS), TAX_ALIASES)


def _parsed(rows: DataFrame, raws: list[Column]) -> DataFrame:
    """Rows with numbers as printed in ``s0`` and on, and as numbers in ``n0`` and on: each is read once."""
    rows = rows.withColumns({f"r{i}": raw for i, raw in enumerate(raws)})
    return rows.withColumns({f"s{i}": read_text(F.col(f"r{i}")) for i in range(len(raws))} | {f"n{i}": parse_decimal(F.col(f"r{i}")) for i in range(len(raws))})


def _line_struct(texts: dict[str, Column], said: dict[str, Column], numbers: dict[str, Column], page_no: Column, at: Column, tolerance: float) -> Column:
    """What an item of lines says, from its place, its texts and its numbers as printed and parsed, with what is wrong with it."""
    product = (numbers["quantity"] * numbers["unit_price"]).cast("decimal(38,12)")
    names = {"quantity": "cantidad", "unit_price": "precio unitario", "amount": "importe"}
    lost = {"quantity": "Falta la cantidad de la línea.", "unit_price": "Falta el precio unitario de la línea.", "amount": "Falta el importe de la línea."}
    wrong = [F.when(numbers[n].isNull() & said[n].isNotNull(), F.format_string(f"Página %d, línea %d, {label}: Valor numérico no válido: %s", page_no, at + 1, said[n])) for n, label in names.items()]
    wrong.append(F.when(~within_tolerance(product, numbers["amount"], tolerance), "Cantidad por precio unitario no coincide con el importe."))
    wrong.append(F.when(texts["description"].isNull(), "Falta la descripción de la línea."))
    wrong += [F.when(numbers[n].isNull(), text) for n, text in lost.items()]
    return F.struct(*[v.alias(n) for n, v in (texts | numbers).items()], F.filter(F.array(*wrong), lambda w: w.isNotNull()).alias("warnings"))


def draft_lines(pages: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """One row an item, with its numbers and what is wrong with it."""
    fields = _line_fields(F.col("keys"))
    rows = _parsed(_items(pages, "line_items").withColumns({f"_{n}": optional_text(fields[n]) for n in _LINE_TEXTS}), [fields[n] for n in _LINE_NUMBERS])
    said, numbers = ({n: F.col(f"{kind}{i}") for i, n in enumerate(_LINE_NUMBERS)} for kind in "sn")
    rows = rows.withColumn("l", _line_struct({n: F.col(f"_{n}") for n in _LINE_TEXTS}, said, numbers, F.col("page_no"), F.col("at"), tolerance))
    return rows.select("doc_id", "page_no", "at", "l.*")


def _tax_struct(tax_type: Column, said: list[Column], numbers: list[Column]) -> Column:
    """What a tax row says, from its numbers as printed and parsed, and how many of them are none."""
    bad = reduce(lambda a, b: a + b, [(n.isNull() & s.isNotNull()).cast("int") for s, n in zip(said, numbers, strict=True)])
    return F.struct(tax_type.alias("tax_type"), *[v.alias(n) for n, v in zip(_TAX_NUMBERS, numbers, strict=True)], bad.alias("bad"))


_TAX = ("tax_type", "rate", "taxable_base", "amount")


def draft_taxes(pages: DataFrame) -> DataFrame:
    """Tax rows that say something, the first of equal ones."""
    fields = _tax_fields(F.col("keys"))
    rows = _parsed(_items(pages, "taxes"), [fields[n] for n in _TAX_NUMBERS])
    rows = rows.withColumn("t", _tax_struct(optional_text(fields["tax_type"]), *([F.col(f"{kind}{i}") for i in range(3)] for kind in "sn"))).select("doc_id", "page_no", "at", "t.*")
    by = W.partitionBy("doc_id", *_TAX).orderBy("page_no", "at")
    said = F.coalesce(*[F.col(n).cast("string") for n in _TAX]).isNotNull()
    kept = rows.withColumn("n", F.row_number().over(by)).where((F.col("n") == 1) & said)
    return kept.select("doc_id", "page_no", "at", *_TAX, "bad")


def tax_totals(taxes: DataFrame) -> DataFrame:
    return taxes.groupBy("doc_id").agg(F.sum("amount").alias("t_amount"), F.sum("taxable_base").alias("t_base"), F.when(F.count("*") == 1, F.first("rate")).alias("t_rate"))


def backfill_totals(headers: DataFrame, taxes: DataFrame) -> DataFrame:
    """Headers whose tax amount, base or rate is absent take them from the tax rows; the rate only from a single row."""
    return _backfilled(headers.join(tax_totals(taxes), "doc_id", "left"))


def _backfilled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"tax_amount": F.coalesce("tax_amount", "t_amount"), "taxable_base": F.coalesce("taxable_base", "t_base"), "tax_rate": F.coalesce("tax_rate", "t_rate")}).drop("t_amount", "t_base", "t_rate")


def line_totals(lines: DataFrame) -> DataFrame:
    complete = F.col("description").isNotNull() & F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & F.col("amount").isNotNull()
    return lines.groupBy("doc_id").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("line_total"), F.count_if(complete).alias("complete"), F.count_if(~complete).alias("pending"), F.sum(F.size("warnings")).alias("line_warnings"))


def missing_fields(headers: DataFrame) -> Column:
    """The required fields that are null, and ``lines`` if there are none."""
    n_lines = F.col("n_lines") if "n_lines" in headers.columns else F.col("complete") + F.col("pending")
    lost = [F.when(F.col(n).isNull(), F.lit(n)) for n in REQUIRED] + [F.when(F.coalesce(n_lines, F.lit(0)) == 0, F.lit("lines"))]
    return F.filter(F.array(*lost), lambda x: x.isNotNull())


def _with_headers(rows: DataFrame) -> DataFrame:
    """Rows that ``held`` the pages of a document, with its header fields, their contradictions and bad numbers."""
    names, held = (*TEXTS, *NUMBERS), F.col("held")
    clashes = F.array_sort(F.filter(F.array(*[_clash(held, n) for n in names]), lambda w: w.isNotNull()))
    values = {n: _value(held, n) for n in TEXTS} | {"currency": F.upper(_value(held, "currency"))} | {n: _value(held, n).cast("decimal(28,6)") for n in NUMBERS}
    bad = reduce(lambda a, b: a + b, [_bad(held, n) for n in NUMBERS])
    return rows.withColumns(values | {"clashes": clashes, "bad": bad})


def draft_headers(pages: DataFrame) -> DataFrame:
    """One row a document: header fields, and the count of their warnings."""
    return _with_headers(_gather(pages)).drop("held")


def _with_taxes(rows: DataFrame) -> DataFrame:
    """Rows with the ``taxes`` of a document in order, with what they sum up to, the first of equal ones."""
    key = lambda t: F.struct(*[t[n].alias(n) for n in _TAX])
    said = lambda t: F.coalesce(*[t[n].cast("string") for n in _TAX]).isNotNull()
    kept = let(F.col("taxes"), lambda all_: let(F.transform(all_, key), lambda keys: F.filter(all_, lambda t, i: (F.array_position(keys, key(t)) == i + 1) & said(t))))
    rows = rows.withColumn("taxes", kept)

    def total(name: str) -> Column:
        values = F.filter(F.transform("taxes", lambda t: t[name].cast("decimal(38,6)")), lambda v: v.isNotNull())
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast("decimal(38,6)"), lambda a, b: (a + b).cast("decimal(38,6)")))

    return rows.withColumns({
        "t_amount": total("amount"), "t_base": total("taxable_base"), "t_rate": F.when(F.size("taxes") == 1, F.get("taxes", 0)["rate"]),
        "bad_taxes": F.aggregate("taxes", F.lit(0).cast("long"), lambda acc, t: acc + t["bad"]),
    })


def _item_keys(raw: Column) -> Column:
    """The items of raw JSON as maps of their keys, in one pass where all are objects, else each by itself (null, if it is none)."""
    each = F.transform(F.from_json(raw, "array<string>"), lambda item: F.from_json(item, KEYS))
    return F.coalesce(F.from_json(raw, f"array<{KEYS}>"), each, F.array().cast(f"array<{KEYS}>"))


def _read(numbers: list[Column], texts: list[Column], body) -> Column:
    """``body`` of raw numbers as printed, of the same parsed, and of texts; how a number is printed is only read where it is none."""

    def of(raw: Column) -> Column:
        said = [optional_text(raw[f"s{i}"]) for i in range(len(numbers))]
        read = F.struct(*[optional_text(raw[f"t{i}"]).alias(f"t{i}") for i in range(len(texts))], *[parse_decimal(raw[f"s{i}"]).alias(f"n{i}") for i in range(len(numbers))])
        return let(read, lambda x: body(said, *([x[f"{k}{i}"] for i in range(len(own))] for k, own in (("n", numbers), ("t", texts)))))

    return let(F.struct(*[c.alias(f"{k}{i}") for k, own in (("s", numbers), ("t", texts)) for i, c in enumerate(own)]), of)


def _line_of(keys: Column, page_no: Column, at: Column, tolerance: float) -> Column:
    fields = _line_fields(keys)

    def body(said: list[Column], numbers: list[Column], texts: list[Column]) -> Column:
        named = (dict(zip(names, own, strict=True)) for names, own in ((_LINE_TEXTS, texts), (_LINE_NUMBERS, said), (_LINE_NUMBERS, numbers)))
        return _line_struct(*named, page_no, at, tolerance)

    return _read([fields[n] for n in _LINE_NUMBERS], [fields[n] for n in _LINE_TEXTS], body)


def _tax_of(keys: Column) -> Column:
    fields = _tax_fields(keys)
    return _read([fields[n] for n in _TAX_NUMBERS], [fields["tax_type"]], lambda said, numbers, texts: _tax_struct(texts[0], said, numbers))


def invoice_draft(payloads: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """One row a document: the whole draft with its checks.

    ``payloads`` has ``doc_id, page_no, payload, raw_text, errors`` and may have ``status``.
    Items are summed up within the row of their page; one grouping by document gathers pages
    and taxes, of which a document has few.  What is only asked of some checks is a column of
    its own, so that a plan that asks for less leaves it out.
    """
    pages = parse_payload(payloads)
    status = F.col("status") if "status" in pages.columns else F.lit("success")
    rows = _parsed(pages.withColumns({"status": status, "line_keys": _item_keys(F.col("line_items")), "tax_keys": _item_keys(F.col("taxes"))}), [F.col(n) for n in NUMBERS])
    amount, page_no = "decimal(28,6)", F.col("page_no")
    rows = rows.select(
        "doc_id", "page_no", "status", _page_struct().alias("page"), F.coalesce(F.json_array_length("line_items"), F.size("line_keys")).cast("long").alias("n_lines"),
        F.aggregate(F.transform("line_keys", lambda k: let(_line_fields(k)["amount"], parse_decimal)), F.lit(0).cast(amount), lambda acc, x: (acc + F.coalesce(x, F.lit(0).cast("decimal(18,6)"))).cast(amount)).alias("line_total"),
        F.transform("line_keys", lambda k, i: _line_of(k, page_no, i, tolerance)).alias("lines"), F.transform("tax_keys", _tax_of).alias("taxes"),
    )
    whole = lambda x: x["description"].isNotNull() & x["quantity"].isNotNull() & x["unit_price"].isNotNull() & x["amount"].isNotNull()
    rows = rows.withColumns({"complete": F.size(F.filter("lines", whole)).cast("long"), "line_warnings": F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + F.size(x["warnings"]))})
    rows = rows.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.lower(F.max("status")).alias("status"), F.sort_array(F.collect_list("page")).alias("held"), F.sort_array(F.collect_list(F.struct("page_no", "taxes"))).alias("taxes"),
        F.sum("line_total").cast(amount).alias("line_total"), F.sum("complete").alias("complete"), F.sum("n_lines").alias("n_lines"), F.sum("line_warnings").alias("line_warnings"),
    )
    warned = F.flatten(F.transform("held", lambda p: p["page_warnings"]))
    rows = rows.withColumns({"page_warnings": warned, "taxes": F.flatten(F.col("taxes")["taxes"]), "pending": F.col("n_lines") - F.col("complete")})
    rows = _backfilled(_with_taxes(_with_headers(rows).drop("held")).drop("taxes"))
    return draft_checks(rows.withColumn("missing", missing_fields(rows)), tolerance).drop("n_lines")


def draft_checks(rows: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Lines against the base, base and tax against the total, and whether the draft is ready:
    nothing missing or pending, both checks true, extracted with success and no warning at all."""
    has_lines = (F.col("n_lines") if "n_lines" in rows.columns else F.col("complete") + F.col("pending")) > 0
    rows = rows.withColumns({
        "lines_match": F.when(has_lines, within_tolerance(F.col("line_total"), F.col("taxable_base"), tolerance)),
        "total_match": within_tolerance(F.col("taxable_base") + F.col("tax_amount"), F.col("invoice_total"), tolerance),
    })
    own = F.array(F.when(~F.col("lines_match"), "La suma de líneas no coincide con la base imponible."), F.when(~F.col("total_match"), "La base imponible más impuestos no coincide con el total."))
    warnings = F.filter(F.concat(F.coalesce("page_warnings", F.array().cast("array<string>")), F.coalesce("clashes", F.array().cast("array<string>")), own), lambda w: w.isNotNull())
    rows = rows.withColumn("warnings", warnings)
    clean = (F.size("warnings") == 0) & (F.coalesce("bad", F.lit(0)) == 0) & (F.coalesce("bad_taxes", F.lit(0)) == 0) & (F.coalesce("line_warnings", F.lit(0)) == 0)
    ready = (F.size("missing") == 0) & (F.col("pending") == 0) & F.col("lines_match") & F.col("total_match") & (F.col("status") == "success") & clean
    return rows.withColumn("ready", F.coalesce(ready, F.lit(False))).drop("page_warnings", "clashes")
