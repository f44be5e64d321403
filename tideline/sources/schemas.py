"""The nested documents the engine works on."""

from __future__ import annotations

ITEM = "struct<id:string,title:string,seller_sku:string,variation_id:string>"
LINES = f"array<struct<quantity:double,unit_price:double,item:{ITEM}>>"
ORDER = (
    "id string, status string, date_created string, paid_amount double, total_amount double,"
    f" order_items {LINES}, buyer struct<nickname:string>, shipping struct<id:string,logistic_type:string>, ordinal bigint"
)
RAW_ORDER = ORDER + ", cancel_detail struct<`group`:string,code:string,description:string>"
LISTING = (
    "id string, title string, status string, price double, original_price double, available_quantity double, sold_quantity double,"
    " listing_type_id string, catalog_listing boolean, inventory_id string, permalink string, thumbnail string, last_updated string,"
    " seller_custom_field string, seller_sku string, tags array<string>, shipping struct<logistic_type:string>,"
    " attributes array<struct<id:string,value_name:string>>, ordinal bigint"
)
SHIPMENT = "shipment_id string, logistic_type string, custo_frete double"
COST_RULE = "ordem int, id string, custo_produto double, sku array<string>, `match` array<string>, tipo array<string>, exclui array<string>"
SKU_MAP = "item_id string, sku string"
