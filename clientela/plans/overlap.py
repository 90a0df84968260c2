"""How many identities each registry and each combination of registries holds."""

from __future__ import annotations

from pyspark.sql import DataFrame

_OVERLAP = """
WITH ifood AS (
  SELECT document_number, count(1) AS c, count(id) AS c_id FROM {ifood} GROUP BY document_number),
food99 AS (
  SELECT phone_number, count(1) AS u, count(c_uid) AS u_id FROM {food99} GROUP BY phone_number),
store AS (
  SELECT document_number, phone_number, count(1) AS s FROM {store} GROUP BY document_number, phone_number),
matched AS (
  SELECT s, IF(store.document_number IS NULL, 0, s) AS documented, coalesce(c, 1) AS apps, coalesce(c_id, 0) AS app_ids,
         coalesce(u, 1) AS foods, coalesce(u_id, 0) AS food_ids
  FROM store
  LEFT JOIN ifood ON '=' || store.document_number = '=' || ifood.document_number
  LEFT JOIN food99 ON '=' || store.phone_number = '=' || food99.phone_number),
parts AS (
  SELECT sum(s * apps * foods) AS total, sum(s * app_ids * foods) AS app, sum(documented * apps * foods) AS shop,
         sum(s * apps * food_ids) AS food, sum(documented * apps * food_ids) AS shop_food,
         sum(s * app_ids * foods) AS shop_app, sum(s * app_ids * food_ids) AS app_food
  FROM matched
  UNION ALL
  SELECT sum(c), sum(c_id), 0, 0, 0, 0, 0
  FROM ifood LEFT ANTI JOIN (SELECT DISTINCT document_number FROM store) d ON ifood.document_number = d.document_number
  UNION ALL
  SELECT sum(u), 0, 0, sum(u_id), 0, 0, 0
  FROM food99 LEFT ANTI JOIN (SELECT DISTINCT phone_number FROM store) p ON food99.phone_number = p.phone_number),
totals AS (
  SELECT coalesce(sum(total), 0) AS total, coalesce(sum(app), 0) AS app, coalesce(sum(shop), 0) AS shop,
         coalesce(sum(food), 0) AS food, coalesce(sum(shop_food), 0) AS shop_food,
         coalesce(sum(shop_app), 0) AS shop_app, coalesce(sum(app_food), 0) AS app_food
  FROM parts)
SELECT total AS total_cliente, app AS clientes_ifood, shop AS clientes_loja, food AS clientes_99food,
       shop_food AS clientes_loja_99food, shop_app AS clientes_loja_ifood,
       -- food99 meets the app registry only through a store row, so this pair is always a triple
       app_food AS clientes_ifood_99food, app_food AS clientes_loja_ifood_99food
FROM totals
"""


def channel_overlap(shop) -> DataFrame:
    """Eight counts over the identity relation, from counts per key alone.

    A store row with ``c`` app customers on its document and ``u`` food99 customers on its phone makes
    ``max(c,1) * max(u,1)`` identity rows. Counting with these products never builds the rows, so a
    document or phone shared by very many rows costs one row here. The joins compare marked keys for
    the reason given in :func:`clientela.operators.joins.join_unique`.
    """
    spark = shop.store_customer.sparkSession
    return spark.sql(_OVERLAP, ifood=shop.ifood_customer, store=shop.store_customer, food99=shop.food99_customer)
