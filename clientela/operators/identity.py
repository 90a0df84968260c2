"""One customer identity out of three registries.

The relation is ``ifood FULL JOIN store ON document FULL JOIN food99 ON store phone``. A full outer
join cannot be split when one document or phone is hot, and it sends all rows without a key to one
task. So each full join is written as its three disjoint parts: matches (inner), left rows without a
match and right rows without a match (anti). The adaptive planner can split a hot key in each of
these, and the side that only tests for a match is first cut down to at most 16 rows per key (not to
one: an aggregate by the join key itself would keep the join from being split). Rows without a key get one
that nothing on the other side equals, which spreads them over all tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.labels import CHANNELS, FOOD99, IFOOD, STORE

_REGISTRY_ROWS = """
WITH ifood AS (
  SELECT id AS c_id, document_number AS c_document, first_name AS c_first, last_name AS c_last,
         coalesce('=' || document_number, 'c' || xxhash64(id, first_name, last_name)) AS document_key
  FROM {ifood}),
store AS (
  SELECT document_number AS s_document, phone_number AS s_phone, first_name AS s_first, last_name AS s_last,
         coalesce('=' || document_number, 's' || xxhash64(phone_number, first_name, last_name)) AS document_key,
         coalesce('=' || phone_number, 's' || xxhash64(document_number, first_name, last_name)) AS phone_key
  FROM {store}),
food99 AS (
  SELECT c_uid AS n_uid, phone_number AS n_phone, first_name AS n_first, last_name AS n_last,
         coalesce('=' || phone_number, 'n' || xxhash64(c_uid, first_name, last_name)) AS phone_key
  FROM {food99}),
store_rows AS (
  SELECT store.* EXCEPT (phone_key), n_uid, n_phone, n_first, n_last
  FROM store JOIN food99 ON store.phone_key = food99.phone_key
  UNION ALL
  SELECT store.* EXCEPT (phone_key), NULL, NULL, NULL, NULL
  FROM store LEFT ANTI JOIN (SELECT DISTINCT phone_key, pmod(hash(n_uid), 16) AS part FROM food99 WHERE n_phone IS NOT NULL) p ON store.phone_key = p.phone_key),
registry_rows AS (
  SELECT s.* EXCEPT (document_key), c_id, c_document, c_first, c_last
  FROM store_rows s JOIN ifood ON s.document_key = ifood.document_key
  UNION ALL
  SELECT s.* EXCEPT (document_key), NULL, NULL, NULL, NULL
  FROM store_rows s
  LEFT ANTI JOIN (SELECT DISTINCT document_key, pmod(hash(c_id), 16) AS part FROM ifood WHERE c_document IS NOT NULL) d ON s.document_key = d.document_key
  UNION ALL
  SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, c_id, c_document, c_first, c_last
  FROM ifood
  LEFT ANTI JOIN (SELECT DISTINCT document_key, pmod(hash(s_phone), 16) AS part FROM store WHERE s_document IS NOT NULL) d ON ifood.document_key = d.document_key
  UNION ALL
  SELECT NULL, NULL, NULL, NULL, n_uid, n_phone, n_first, n_last, NULL, NULL, NULL, NULL
  FROM food99
  LEFT ANTI JOIN (SELECT DISTINCT phone_key, pmod(hash(s_document), 16) AS part FROM store WHERE s_phone IS NOT NULL) p ON food99.phone_key = p.phone_key)
SELECT concat_ws({id_sep}, coalesce(c_id, ''), coalesce(n_uid, ''), coalesce(s_document, '')) AS id,
       coalesce(c_id, n_uid) AS customer_id,
       coalesce(n_first, c_first, s_first, '') AS first_name,
       coalesce(n_last, c_last, s_last, '') AS last_name,
       coalesce(c_document, s_document) AS document_number,
       coalesce(s_phone, n_phone) AS phone_number,
       c_id AS customer_id_original,
       n_uid AS c_uid_original,
       s_document AS document_number_ctb,
       c_document AS document_number_c,
       s_phone AS phone_number_ctb,
       n_phone AS phone_number_c9
FROM registry_rows
"""


def resolve_identity(ifood: DataFrame, store: DataFrame, food99: DataFrame, id_sep: str = "") -> DataFrame:
    """The identity relation. ``id_sep`` separates the three keys inside ``id`` (default: nothing)."""
    return ifood.sparkSession.sql(_REGISTRY_ROWS, ifood=ifood, store=store, food99=food99, id_sep=id_sep)


def stacked(keys: Mapping[str, str]) -> str:
    """Expression that turns one key column per channel into rows ``(channel, native_key)``."""
    pairs = ", ".join(f"'{channel}', {key}" for channel, key in keys.items())
    return f"stack({len(keys)}, {pairs}) AS (channel, native_key)"


FULL_NAME = "first_name || ' ' || last_name"

#: What links can carry of their identity row.
CARRIED = {"name": f"{FULL_NAME} AS name", "phone_number": "coalesce(phone_number, '') AS phone_number"}
LINK_KEY = ("channel", "native_key")

NATIVE_KEYS = {IFOOD: "customer_id_original", FOOD99: "c_uid_original", STORE: "document_number_ctb"}


def identity_links(identity: DataFrame, carried: Sequence[str] = (), channels: Sequence[str] = CHANNELS) -> DataFrame:
    """``(channel, native_key, id, ...)``: one row per identity row and channel it is registered in.

    ``carried`` are further expressions over the identity to keep.
    """
    keys = {channel: NATIVE_KEYS[channel] for channel in channels}
    known = identity.where(f"coalesce({', '.join(keys.values())}) IS NOT NULL")
    return known.selectExpr("id", *carried, stacked(keys)).where("native_key IS NOT NULL")


def weighted_links(links: DataFrame) -> DataFrame:
    """Fold repeated links into one row with the number of times they occur (``copies``)."""
    return links.groupBy(*links.columns).agg(F.expr("count(1) AS copies"))
