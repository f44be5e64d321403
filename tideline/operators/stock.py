"""Stock by SKU: own and fulfilled, each physical stock counted once.

Listings can share one physical stock. Fulfilled listings share it by inventory id, else by
SKU, else stand alone; own listings share it by inventory id. Per key the largest quantity
counts. Mode SAFE clamps negative quantities and settles all ties by fixed rules; mode
LEGACY keeps negatives, reads marks exactly as written, and lets the first listing seen decide a key's class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import FULFILMENT, blank_to_null, fixed2, item_sku, rounded

LEGACY, SAFE = "legado", "seguro"
PREMIUM = "gold_pro"
WITHOUT_ID = "sem-inventory"
# Days of stock at which a class ends.
RUPTURE_DAYS, ALERT_DAYS, OK_DAYS = 30, 90, 365
# Texts of an audit.
BLOCK_IGNORED = "Ignorado: o grupo possui estoque próprio com inventory_id; todo o bloco sem inventory_id foi descartado pela regra legada anti-duplicação."
FIRST_OF_KEY = {
    "full": "Primeiro anúncio da chave — saldo considerado.",
    "inv": "Saldo próprio independente (inventory_id distinto soma).",
    "none": "Espelhos sem inventory_id compartilham o mesmo saldo — primeiro anúncio considerado.",
}
CLASS_ORDER = ("ruptura", "alerta", "ok", "excesso", "semvenda")


def is_full(mode: str = SAFE) -> Column:
    """Fulfilled by logistics type or tag, never by title."""
    kind, tags = F.col("shipping.logistic_type"), F.coalesce("tags", F.array().cast("array<string>"))
    if mode == SAFE:
        clean = lambda x: F.lower(F.trim(x)) == FULFILMENT
        return F.coalesce(clean(kind), F.lit(False)) | F.coalesce(F.exists(tags, clean), F.lit(False))
    return F.coalesce(kind == FULFILMENT, F.lit(False)) | F.coalesce(F.array_contains(tags, FULFILMENT), F.lit(False))


def stock_lines(listings: DataFrame, mode: str = SAFE) -> DataFrame:
    """One row per listing: sku, item_id, full, premium, quantity, key (null: own without inventory id), and the like."""
    raw = F.coalesce(F.nanvl("available_quantity", F.lit(0.0)), F.lit(0.0))
    sku = item_sku("seller_custom_field", "attributes", "seller_sku")
    inventory = blank_to_null("inventory_id")
    rows = listings.select(
        F.col("id").alias("item_id"),
        F.coalesce(sku, F.concat(F.lit("sem-sku-"), F.coalesce("id", F.lit("desconhecido")))).alias("sku"),
        "title",
        "status",
        "price",
        "ordinal",
        is_full(mode).alias("full"),
        F.coalesce(F.col("listing_type_id") == PREMIUM, F.lit(False)).alias("premium"),
        raw.alias("original"),
        (F.greatest(raw, F.lit(0.0)) if mode == SAFE else raw).alias("quantity"),
        (raw < 0).alias("negative"),
        (F.col("inventory_id").isNotNull() & inventory.isNull()).alias("bad_inventory_id"),
        F.coalesce(F.concat(F.lit("inv:"), inventory), F.concat(F.lit("sku:"), sku), F.concat(F.lit("item:"), "id")).alias("full_key"),
        F.concat(F.lit("inv:"), inventory).alias("own_key"),
    )
    return rows.withColumn("key", F.when(F.col("full"), F.col("full_key")).otherwise(F.col("own_key"))).drop("full_key", "own_key")


def key_stock(lines: DataFrame, mode: str = SAFE) -> DataFrame:
    """sku, full, key, quantity, premium: each physical stock once."""
    if mode == SAFE:
        first = F.min(F.struct((-F.col("quantity")).alias("q"), (~F.col("premium")).alias("p"), "item_id", "premium"))["premium"]
    else:
        first = F.min(F.struct(F.col("ordinal").isNull().alias("late"), "ordinal", "item_id", "premium"))["premium"]
    return lines.groupBy("sku", "full", "key").agg(F.max("quantity").alias("quantity"), first.alias("premium"))


def consolidate(lines: DataFrame, mode: str = SAFE) -> DataFrame:
    """sku, own, full_classic, full_premium, full, total, own_without_id_ignored.

    Own stock is the sum over inventory ids; only if that is 0 the largest quantity of
    listings without one stands in (at least 0).
    """
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("quantity"))), F.lit(0.0))
    full, has_key = F.col("full"), F.col("key").isNotNull()
    rows = key_stock(lines, mode).groupBy("sku").agg(
        add(full & ~F.col("premium")).alias("full_classic"),
        add(full & F.col("premium")).alias("full_premium"),
        add(~full & has_key).alias("own_by_id"),
        F.max(F.when(~full & ~has_key, F.greatest(F.col("quantity"), F.lit(0.0)))).alias("bucket"),
    )
    own = F.when(F.col("own_by_id") != 0, F.col("own_by_id")).otherwise(F.coalesce("bucket", F.lit(0.0)))
    rows = rows.withColumns({"own": own, "full": F.col("full_classic") + F.col("full_premium"), "own_without_id_ignored": (F.col("own_by_id") != 0) & F.col("bucket").isNotNull()})
    return rows.select("sku", "own", "full_classic", "full_premium", "full", (F.col("own") + F.col("full")).alias("total"), "own_without_id_ignored")


def whole(x: Column) -> Column:
    """A quantity as it is written in a reason: without a fraction where it has none."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def audit(lines: DataFrame) -> DataFrame:
    """Every listing (mode SAFE): key, original and considered quantity, whether it counts, and why."""
    key = F.coalesce("key", F.lit(WITHOUT_ID))
    own_by_id = F.coalesce(F.max(F.when(~F.col("full") & F.col("key").isNotNull() & (F.col("quantity") != 0), True)).over(Window.partitionBy("sku")), F.lit(False))
    rows = lines.withColumns({"dedup_key": key, "dropped": ~F.col("full") & F.col("key").isNull() & own_by_id})
    group = Window.partitionBy("sku", "full", "dedup_key")
    rank = group.orderBy(F.desc("quantity"), F.desc(F.col("full") & F.col("premium")), F.collate("item_id", "UNICODE"), "item_id")
    rows = rows.withColumns({"n": F.row_number().over(rank), "size": F.count(F.lit(1)).over(group)})
    rows = rows.withColumn("winner", F.max(F.when(F.col("n") == 1, F.struct("item_id", "quantity", "premium"))).over(group))
    w = F.col("winner")
    by_item = F.concat(F.lit(" resolvido por itemId lexical ("), w["item_id"], F.lit(" < "), F.col("item_id"), F.lit(")"))
    why = (
        F.when(w["quantity"] != F.col("quantity"), F.concat(F.lit("saldo maior ("), whole(w["quantity"]), F.lit(" > "), whole(F.col("quantity")), F.lit(")")))
        .when(F.col("full") & (w["premium"] != F.col("premium")), "empate de saldo resolvido por premium")
        .when(F.col("full"), F.concat(F.lit("empate de saldo e classe"), by_item))
        .otherwise(F.concat(F.lit("empate de saldo"), by_item))
    )
    of_key = F.when(F.col("full"), F.concat(F.lit(" na chave "), F.col("dedup_key"))).otherwise(F.concat(F.lit(" ("), F.col("dedup_key"), F.lit(")")))
    single = (
        F.when(F.col("full"), F.concat(F.lit("Único anúncio da chave "), F.col("dedup_key"), F.lit(" — saldo considerado.")))
        .when(F.col("key").isNull(), "Único anúncio próprio sem inventory_id — saldo considerado.")
        .otherwise("Saldo próprio independente (inventory_id distinto soma).")
    )
    won = F.when(F.col("full"), F.concat(F.lit("Vencedor determinístico da chave "), F.col("dedup_key"), F.lit("."))).otherwise(F.concat(F.lit("Vencedor determinístico ("), F.col("dedup_key"), F.lit(").")))
    lost = F.concat(F.lit("Deduplicado"), of_key, F.lit(": perdeu para "), w["item_id"], F.lit(" por "), why, F.lit("."))
    reason = F.when(F.col("dropped"), BLOCK_IGNORED).when((F.col("n") == 1) & (F.col("size") == 1), single).when(F.col("n") == 1, won).otherwise(lost)
    counted = (F.col("n") == 1) & ~F.col("dropped")
    out = rows.select("sku", "item_id", F.when(F.col("full"), "full").otherwise("proprio").alias("origin"), "dedup_key", "original", "quantity", counted.alias("considered"), reason.alias("reason"))
    return out.orderBy("sku", F.collate("dedup_key", "UNICODE"), F.desc("considered"), F.collate("item_id", "UNICODE"))


def legacy_audit(lines: DataFrame) -> DataFrame:
    """Every listing (mode LEGACY): key, original and considered quantity, whether it counts, and why.

    Listings of a key are judged as they arrive (by ordinal, those without one last): the first
    counts until one with more stock comes, which then stands in its place. So a listing is
    compared with the best before it, and one that is overtaken with the next record after it.
    """
    arrival = [F.asc_nulls_last("ordinal"), F.col("item_id")]
    kind = F.when(F.col("full"), "full").when(F.col("key").isNotNull(), "inv").otherwise("none")
    rows = lines.withColumns({"kind": kind, "dedup_key": F.coalesce("key", F.lit(WITHOUT_ID))})
    of_key = Window.partitionBy("sku", "kind", "dedup_key")
    best = F.max("quantity").over(of_key.orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1))
    # Without an inventory id a first listing counts whatever its stock, and later ones need more than 0.
    rows = rows.withColumn("first", best.isNull()).withColumn("best", F.when(F.col("kind") == "none", F.greatest(best, F.lit(0.0))).otherwise(best))
    rows = rows.withColumn("record", F.col("first") | (F.col("quantity") > F.col("best")))
    after = Window.partitionBy("sku", "kind", "dedup_key", "record").orderBy(*arrival)
    rows = rows.withColumn("next", F.when(F.col("record"), F.lead(F.struct("item_id", "quantity")).over(after)))
    # Each key's stock counts once, on its last record.
    own = F.sum(F.when((F.col("kind") == "inv") & F.col("record") & F.col("next").isNull(), F.col("quantity"))).over(Window.partitionBy("sku"))
    rows = rows.withColumn("dropped", (F.col("kind") == "none") & (F.coalesce(own, F.lit(0.0)) != 0))
    key, q, n = F.col("dedup_key"), whole(F.col("quantity")), F.col("next")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    by_kind = lambda full, inv, none: F.when(F.col("kind") == "full", full).when(F.col("kind") == "inv", inv).otherwise(none)
    first = by_kind(*[F.lit(t) for t in FIRST_OF_KEY.values()])
    more = by_kind(
        text("Mesma chave ", key, ": saldo maior vence; classe permanece a do primeiro anúncio (quirk legado, não determinístico)."),
        F.lit("Mesmo inventory_id: saldo maior vence."),
        F.lit("Espelhos sem inventory_id compartilham o mesmo saldo — maior saldo considerado."),
    )
    margin = text(" com saldo maior (", whole(n["quantity"]), " > ", q, ").")
    beaten = by_kind(
        text("Deduplicado: mesma chave ", key, "; venceu ", n["item_id"], margin),
        text("Deduplicado: mesmo inventory_id; venceu ", n["item_id"], margin),
        text("Espelho sem inventory_id: venceu ", n["item_id"], " com saldo maior."),
    )
    held = text(whole(F.col("best")), " (>= ", q, ").")
    late = by_kind(
        text("Deduplicado: mesma chave ", key, " já considerada com saldo ", held),
        text("Deduplicado: mesmo inventory_id já considerado com saldo ", held),
        F.lit("Espelho sem inventory_id com saldo menor ou igual — não somado."),
    )
    reason = F.when(F.col("dropped"), BLOCK_IGNORED).when(~F.col("record"), late).when(n.isNotNull(), beaten).when(F.col("first"), first).otherwise(more)
    counted = F.col("record") & n.isNull() & ~F.col("dropped")
    origin = by_kind(F.lit("full"), F.lit("proprio_com_inventory"), F.lit("proprio_sem_inventory"))
    return rows.select("sku", "item_id", origin.alias("origin"), "dedup_key", "original", "quantity", counted.alias("considered"), reason.alias("reason"), "ordinal")


def alerts(lines: DataFrame, mode: str = SAFE) -> DataFrame:
    """sku, kind, item_id (null for a whole SKU): what the numbers hide; in a fixed order."""
    kinds = F.array(
        F.when(F.col("negative"), "saldo_negativo_normalizado" if mode == SAFE else "saldo_negativo"),
        F.when(F.col("bad_inventory_id"), "inventory_id_invalido"),
    )
    single = lines.select("sku", F.explode(F.array_compact(kinds)).alias("kind"), "item_id")
    whole_sku = consolidate(lines, mode).where("own_without_id_ignored").select("sku", F.lit("proprio_sem_inventory_ignorado").alias("kind"), F.lit(None).cast("string").alias("item_id"))
    return single.unionByName(whole_sku).orderBy("sku", "kind", F.col("item_id").asc_nulls_first())


def classified(rows: DataFrame, stock: str, sold: str, days: int) -> DataFrame:
    """Adds velocity (a day, two places), days_of_stock and class. Negative stock or sales and days below 1 are refused."""
    if days < 1:
        raise ValueError("days have to be 1 or more")
    s, v = F.col(stock), F.col(sold)
    bad = (s < 0) | (v < 0)
    speed = F.when(bad, F.raise_error(F.lit("stock and sales can't be negative")).cast("double")).otherwise(fixed2(v / F.lit(float(days))))
    rows = rows.withColumn("velocity", speed)
    left = rounded(F.try_divide(s, F.col("velocity")))
    rows = rows.withColumn("days_of_stock", F.when(F.col("velocity") > 0, left).cast("long"))
    d = F.col("days_of_stock")
    name = F.when(d.isNull(), "semvenda").when(d < RUPTURE_DAYS, "ruptura").when(d < ALERT_DAYS, "alerta").when(d <= OK_DAYS, "ok").otherwise("excesso")
    return rows.withColumn("class", name)


def stock_by_sku(listings: DataFrame, units_by_item: DataFrame | None = None, days: int = 30, view: str = "own", mode: str = SAFE, active_only: bool = True) -> DataFrame:
    """One row per SKU: label, listings, stock, max price, units sold; with sales also velocity, days and class.

    view own looks at active listings and own stock, view full at all listings and fulfilled stock.
    """
    lines = stock_lines(listings.where("status = 'active'") if view == "own" and active_only else listings, mode)
    if view == "full":
        lines = lines.where(F.col("full"))
    short = F.min(F.when(F.col("title") != "", F.struct(F.length("title").alias("l"), "ordinal", "title")))["title"]
    price = F.coalesce(F.max("price"), F.lit(0.0))
    if units_by_item is not None:
        lines = lines.join(units_by_item.select("item_id", F.col("units").alias("sold")), "item_id", "left")
        sold = F.coalesce(F.sum(F.coalesce("sold", F.lit(0.0))), F.lit(0.0))
    else:
        sold = F.lit(None).cast("double")
    facts = lines.groupBy("sku").agg(short.alias("label"), F.count(F.lit(1)).alias("listings"), price.alias("max_price"), sold.alias("sold") if units_by_item is not None else F.max(sold).alias("sold"))
    stock = consolidate(lines, mode).select("sku", F.col("own" if view == "own" else "full").alias("stock"))
    rows = facts.join(stock, "sku")
    if units_by_item is None:
        return rows.drop("sold").orderBy("sku")
    rows = classified(rows, "stock", "sold", days)
    place = F.array_position(F.array(*[F.lit(c) for c in CLASS_ORDER]), F.col("class"))
    return rows.orderBy(place, F.col("days_of_stock").asc_nulls_last(), "sku")
