"""Generic collections, with customers as the documents."""

from __future__ import annotations

from docpipe.registry import query
from docpipe.registry.text import hash_id
from docpipe.sources import collections as coll

CUSTOMERS = "SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer"
SUPPLIERS = "SELECT s_name AS name, s_acctbal AS balance, s_nationkey AS nation FROM supplier"
# One update per ordering customer; balance may become null.
UPDATES = """
SELECT CAST(o_custkey AS STRING) AS id, concat('orders: ', CAST(count(*) AS STRING)) AS name,
  CASE WHEN count(*) % 2 = 0 THEN max(o_totalprice) END AS balance FROM orders GROUP BY o_custkey"""
WANTED = "SELECT DISTINCT CAST(l_suppkey AS STRING) AS id FROM lineitem"


@query("collection_insert", f"""
SELECT id, name, segment, balance, CAST(NULL AS INT) AS nation FROM ({CUSTOMERS})
UNION ALL SELECT {hash_id('name')}, name, NULL, balance, nation FROM ({SUPPLIERS})""")
def collection_insert(x):
    return coll.collection_insert(x.sql(CUSTOMERS), x.sql(SUPPLIERS), "id", ["name"])


@query("collection_get", f"""
SELECT w.id, c.name, c.segment, c.balance FROM ({WANTED}) w LEFT JOIN ({CUSTOMERS}) c ON c.id = w.id""")
def collection_get(x):
    return coll.collection_get(x.sql(CUSTOMERS), x.sql(WANTED), "id")


@query("collection_update", f"""
SELECT c.id, CASE WHEN u.id IS NULL THEN c.name ELSE u.name END AS name, c.segment,
  CASE WHEN u.id IS NULL THEN c.balance ELSE u.balance END AS balance
FROM ({CUSTOMERS}) c LEFT JOIN ({UPDATES}) u ON u.id = c.id""")
def collection_update(x):
    return coll.collection_update(x.sql(CUSTOMERS), x.sql(UPDATES), ["name", "balance"], "id")


@query("collection_delete", f"SELECT * FROM ({CUSTOMERS}) WHERE id NOT IN ({WANTED})")
def collection_delete(x):
    return coll.collection_delete(x.sql(CUSTOMERS), x.sql(WANTED), "id")


@query("collection_flags", f"SELECT id, id IN (SELECT id FROM ({CUSTOMERS})) AS deleted FROM ({WANTED})")
def collection_flags(x):
    return coll.collection_flags(x.sql(CUSTOMERS), x.sql(WANTED), "id", "deleted")


@query("collection_query", f"""
SELECT * FROM ({CUSTOMERS}) WHERE segment = 'BUILDING' ORDER BY id LIMIT 100 OFFSET 10""")
def collection_query(x):
    return coll.collection_query(x.sql(CUSTOMERS), {"segment": "BUILDING"}, "id", offset=10)
