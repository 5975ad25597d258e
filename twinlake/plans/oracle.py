"""DuckDB oracle: the same inputs and answers written independently in SQL.

The fixtures here are the SQL twins of ``twinlake.sources.fixtures``; each query
key's SQL is in ``ORACLE``.  Column names match the Spark plans exactly.
"""

from __future__ import annotations

# Fixture CTEs (DuckDB dialect).  Order matters: later ones may use earlier ones.
FX: dict[str, str] = {
    "ab": """SELECT l_suppkey AS author_id, l_partkey AS book_id, min(l_shipdate) AS assigned_at
             FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "orders_read": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
               o_orderdate, o_orderpriority
        FROM orders WHERE o_orderkey % 10 <> 3
        UNION ALL
        SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        FROM orders WHERE o_orderkey % 50 = 0""",
    "ab_read": """
        SELECT author_id, book_id, assigned_at FROM ab WHERE (author_id + book_id) % 10 <> 3
        UNION ALL
        SELECT author_id, book_id + 1000000, assigned_at FROM ab WHERE (author_id + book_id) % 50 = 0""",
    "child": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL
                    WHEN o_orderkey % 11 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS o_custkey
        FROM orders""",
    "cust_read": """
        SELECT a.c_custkey, CASE WHEN a.c_custkey % 100 = 0 THEN b.c_name ELSE a.c_name END AS c_name
        FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 1""",
    "cmd": """
        SELECT event_id, ts, user_id AS id,
               CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'update'
                               WHEN 'error' THEN 'delete' ELSE 'get' END AS op,
               event_id % 3 <> 1 AS has_value, event_id % 3 <> 0 AS has_props, value,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE props END AS props
        FROM events""",
    "assign": """
        SELECT CASE WHEN l_suppkey % 20 = 19 THEN l_suppkey + 1000000 ELSE l_suppkey END AS author_id,
               CASE WHEN l_partkey % 50 = 49 THEN l_partkey + 1000000 ELSE l_partkey END AS book_id,
               l_shipdate AS ts, l_orderkey, l_linenumber, l_returnflag
        FROM lineitem""",
    "payload": """
        SELECT p_partkey,
               CASE WHEN p_partkey % 9 = 0 THEN substr(p_name, 1, 2) ELSE p_name END AS title,
               CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '123'
                    WHEN p_partkey % 13 = 0 THEN repeat('9', 14)
                    ELSE lpad(CAST(p_partkey % 1500 AS VARCHAR), 13, '0') END AS isbn,
               CASE WHEN p_partkey % 5 = 0 THEN 'abc' ELSE CAST(1900 + p_size AS VARCHAR) END AS yr
        FROM part""",
    "req": "SELECT event_id, ts FROM events",
    "rep": """SELECT event_id, ts + to_seconds(CAST(event_id % 15 AS BIGINT)) AS rts
              FROM events WHERE event_id % 29 <> 0""",
    "text_write": "SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 4",
    "text_read": """
        SELECT doc_id,
               CASE WHEN doc_id % 6 = 1 THEN concat(text, ' x')
                    WHEN lang = 'en' AND doc_id % 4 = 0 AND text NOT LIKE '%ß%'
                         THEN upper(replace(text, ' ', '  '))
                    ELSE text END AS text
        FROM documents WHERE doc_id % 10 <> 3""",
    "logrec": """
        SELECT c_custkey,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'error' WHEN 'BUILDING' THEN 'warn'
                    WHEN 'FURNITURE' THEN 'log' WHEN 'HOUSEHOLD' THEN 'debug'
                    WHEN 'MACHINERY' THEN 'verbose' ELSE 'log' END AS level,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'Svc' || CAST(c_nationkey AS VARCHAR) END AS context,
               c_name, CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS VARCHAR) AS nk
        FROM customer""",
    "msg0": """
        SELECT event_id,
               (['author.create', 'author.update', 'author.delete', 'author.get', 'author.getAll',
                 'book.create', 'book.update', 'book.delete', 'book.get', 'book.getAll',
                 'authorBook.assign', 'authorBook.unassign'])[(event_id + event_id // 12) % 12 + 1] AS topic,
               '"' || lpad(CAST(user_id AS VARCHAR), 8, '0') || '-0000-4000-8000-000000000000"' AS uid
        FROM events""",
    "msg": """
        SELECT event_id, topic, '{'
            || '"id":' || CASE event_id % 7 WHEN 0 THEN '"no-uuid"' WHEN 1 THEN 'null' WHEN 2 THEN '12' WHEN 3 THEN '""' ELSE uid END
            || ',"authorId":' || CASE event_id % 5 WHEN 0 THEN '"no-uuid"' ELSE uid END
            || ',"bookId":' || CASE event_id % 9 WHEN 0 THEN 'null' ELSE uid END
            || ',"firstName":' || CASE event_id % 8 WHEN 0 THEN '7' WHEN 1 THEN '"Al"' WHEN 2 THEN 'null' WHEN 3 THEN '""'
                                                   ELSE '"Anna ' || event_id || '"' END
            || ',"lastName":' || CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN '"Li"' ELSE '"Lind"' END
            || ',"birthDate":' || CASE event_id % 5 WHEN 0 THEN '"not-a-date"' WHEN 1 THEN 'null' ELSE '"1980-01-02"' END
            || ',"title":' || CASE event_id % 9 WHEN 0 THEN 'null' WHEN 1 THEN '"Ab"' WHEN 2 THEN '3' ELSE '"Long title"' END
            || ',"isbn":' || CASE event_id % 10 WHEN 0 THEN 'null' WHEN 1 THEN '"123"' WHEN 2 THEN '"99999999999999"'
                                               WHEN 3 THEN '9' ELSE '"1234567890"' END
            || ',"publishedYear":' || CASE event_id % 11 WHEN 0 THEN '"x"' WHEN 1 THEN '1999.5' WHEN 2 THEN 'null' ELSE '1999' END
            || ',"page":' || CASE event_id % 13 WHEN 0 THEN '0' WHEN 1 THEN 'null' WHEN 2 THEN '1.5' WHEN 3 THEN '"2"'
                                               WHEN 4 THEN '"x"' ELSE '1' END
            || ',"limit":' || CASE event_id % 17 WHEN 0 THEN '0' WHEN 1 THEN '101' WHEN 2 THEN 'null' WHEN 3 THEN '"100"' ELSE '100' END
            || ',"extra":"dropped"}' AS payload
        FROM msg0""",
}

_DEPS = {"ab_read": ["ab"], "msg": ["msg0"]}


def with_(*names: str) -> str:
    """WITH clause holding the named fixtures (and what they depend on), in FX order."""
    want: set[str] = set()
    for n in names:
        want.add(n)
        want.update(_DEPS.get(n, []))
    parts = [f"{n} AS ({FX[n]})" for n in FX if n in want]
    return "WITH " + ",\n".join(parts) + "\n"


ORACLE: dict[str, str] = {}


def register(key: str, sql: str) -> None:
    ORACLE[key] = sql.strip()


# --- FX-LIST ---------------------------------------------------------------
register("scan_full", "SELECT * FROM orders")
register("scan_keys", "SELECT o_orderkey FROM orders")
register("list_filter_eq",
         "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
register("list_filter_none", "SELECT * FROM orders")
register("list_newest_first", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey")
register("list_page", """
    SELECT * FROM orders WHERE o_orderstatus = 'F'
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20""")
register("list_page_meta", """
    SELECT CAST(3 AS BIGINT) AS page, CAST(10 AS BIGINT) AS page_limit, count(*) AS total,
           CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages
    FROM orders WHERE o_orderstatus = 'F'""")
register("list_page_with_meta", """
    WITH p AS (SELECT * FROM orders WHERE o_orderstatus = 'F'
               ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20),
         m AS (SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F')
    SELECT p.*, CAST(3 AS BIGINT) AS page, CAST(10 AS BIGINT) AS page_limit, m.total,
           CAST(ceil(m.total / 10.0) AS BIGINT) AS total_pages
    FROM p, m""")
register("lookup_by_id", "SELECT * FROM orders WHERE o_orderkey = 4242")
register("lookup_many_with_status", with_("orders_read") + """
    SELECT r.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
           CASE WHEN o.o_orderkey IS NULL THEN 404 ELSE 200 END AS status
    FROM (SELECT o_orderkey FROM orders_read) r LEFT JOIN orders o ON r.o_orderkey = o.o_orderkey""")
register("key_high_water_mark", """
    SELECT 'orders' AS table_name, max(o_orderkey) AS max_key,
           CAST(CASE WHEN max(o_orderkey) >= 1 THEN max(o_orderkey) ELSE 1 END AS BIGINT) AS last_value,
           coalesce(max(o_orderkey) >= 1, false) AS is_called,
           CAST(CASE WHEN max(o_orderkey) >= 1 THEN max(o_orderkey) + 1 ELSE 1 END AS BIGINT) AS next_value
    FROM orders""")
register("fn_iso_timestamp", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_iso FROM orders""")
register("array_membership", """
    SELECT o_orderkey, o_orderpriority FROM orders
    WHERE list_contains(['1-URGENT', '2-HIGH'], o_orderpriority)""")

# --- S3 --------------------------------------------------------------------
_INV = [t for t in sorted(["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                            "documents", "embeddings", "pages", "benchmark", "labels", "conversations"])
        if t not in ("pages", "benchmark")]
register("table_inventory", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _INV))

# --- FX-M2N ----------------------------------------------------------------
_REL_L = with_("ab") + """, rel AS (SELECT ab.author_id, p.* FROM ab JOIN part p ON ab.book_id = p.p_partkey)
"""
_REL_R = with_("ab") + """, rel AS (SELECT ab.book_id, s.* FROM ab JOIN supplier s ON ab.author_id = s.s_suppkey)
"""
register("m2n_expand_left", _REL_L + """
    SELECT s.s_suppkey, s.s_name, count(rel.p_partkey) AS n_related,
           CAST(sum(CAST(rel.p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_related
    FROM supplier s LEFT JOIN rel ON rel.author_id = s.s_suppkey GROUP BY s.s_suppkey, s.s_name""")
register("m2n_expand_right", _REL_R + """
    SELECT p.p_partkey, p.p_name, count(rel.s_suppkey) AS n_related,
           CAST(sum(CAST(rel.s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS sum_related
    FROM part p LEFT JOIN rel ON rel.book_id = p.p_partkey GROUP BY p.p_partkey, p.p_name""")
register("m2n_expand_rows", _REL_L + """
    SELECT s.s_suppkey, s.s_name, rel.p_partkey, rel.p_name
    FROM supplier s LEFT JOIN rel ON rel.author_id = s.s_suppkey""")
register("multi_key_join", with_("ab") + """
    SELECT l_orderkey, l_linenumber, author_id, book_id, assigned_at
    FROM lineitem JOIN ab ON l_suppkey = author_id AND l_partkey = book_id""")
register("cascade_delete", with_("ab") + """
    SELECT * FROM ab WHERE NOT EXISTS (
        SELECT 1 FROM supplier s WHERE s.s_suppkey % 7 = 0 AND s.s_suppkey = ab.author_id)""")
register("sync_children", with_("ab_read") + """
    , par AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)
    SELECT * FROM ab_read r WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.s_suppkey = r.author_id)
    UNION ALL
    SELECT * FROM ab w WHERE EXISTS (SELECT 1 FROM par WHERE par.s_suppkey = w.author_id)""")

# --- FX-REPLICA ------------------------------------------------------------
_DIFF_ORDERS = """
    SELECT coalesce(w.o_orderkey, r.o_orderkey) AS o_orderkey,
           CASE WHEN r.o_orderkey IS NULL THEN 'insert'
                WHEN w.o_orderkey IS NULL THEN 'delete'
                WHEN w.o_custkey IS NOT DISTINCT FROM r.o_custkey
                 AND w.o_orderstatus IS NOT DISTINCT FROM r.o_orderstatus
                 AND w.o_totalprice IS NOT DISTINCT FROM r.o_totalprice
                 AND w.o_orderdate IS NOT DISTINCT FROM r.o_orderdate
                 AND w.o_orderpriority IS NOT DISTINCT FROM r.o_orderpriority THEN 'same'
                ELSE 'update' END AS action
    FROM orders w FULL OUTER JOIN orders_read r ON w.o_orderkey = r.o_orderkey"""
_DIFF_AB = """
    SELECT CASE WHEN r.author_id IS NULL THEN 'insert' WHEN w.author_id IS NULL THEN 'delete'
                ELSE 'same' END AS action
    FROM ab w FULL OUTER JOIN ab_read r ON w.author_id = r.author_id AND w.book_id = r.book_id"""
register("row_diff", with_("orders_read") + _DIFF_ORDERS)
register("row_diff_pruned", """
    WITH day AS (SELECT max(CAST(o_orderdate AS DATE)) AS latest FROM orders)
    SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) = latest THEN 'insert'
                            WHEN CAST(o_orderdate AS DATE) = latest - 1 AND o_orderpriority IS NOT NULL THEN 'update' ELSE 'same' END AS action
    FROM orders, day
    UNION ALL SELECT -1 - o_orderkey, 'delete' FROM orders, day WHERE CAST(o_orderdate AS DATE) = latest""")
register("upsert_by_key", with_("orders_read") + """
    SELECT * FROM orders_read r WHERE NOT EXISTS (SELECT 1 FROM orders w WHERE w.o_orderkey = r.o_orderkey)
    UNION ALL SELECT * FROM orders""")
register("insert_if_absent", with_("orders_read") + """
    SELECT * FROM orders_read
    UNION ALL
    SELECT * FROM orders w WHERE NOT EXISTS (SELECT 1 FROM orders_read r WHERE r.o_orderkey = w.o_orderkey)""")
register("delete_orphans", with_("orders_read") + """
    SELECT * FROM orders_read r WHERE EXISTS (SELECT 1 FROM orders w WHERE w.o_orderkey = r.o_orderkey)""")
register("orphans_single_key", with_("orders_read") + """
    SELECT * FROM orders_read r WHERE NOT EXISTS (SELECT 1 FROM orders w WHERE w.o_orderkey = r.o_orderkey)""")
_IDS = with_("orders_read") + """
    , ids AS (SELECT o_orderkey FROM orders_read WHERE o_orderpriority = '1-URGENT'
              UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'),
      rws AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM ids))
"""
register("sync_rows_by_id", _IDS + """
    SELECT * FROM orders_read r WHERE NOT EXISTS (SELECT 1 FROM rws WHERE rws.o_orderkey = r.o_orderkey)
    UNION ALL SELECT * FROM rws""")
register("sync_rows_missing", _IDS + """
    SELECT o_orderkey FROM ids WHERE NOT EXISTS (SELECT 1 FROM orders w WHERE w.o_orderkey = ids.o_orderkey)""")
register("delete_rows_by_id", with_("orders_read") + """
    SELECT * FROM orders_read r WHERE NOT EXISTS (
        SELECT 1 FROM orders w WHERE w.o_orderstatus = 'P' AND w.o_orderkey = r.o_orderkey)""")
register("cdc_apply", "SELECT * FROM orders")
register("sync_report", with_("orders_read", "ab_read") + f"""
    SELECT 'orders' AS table_name, action, count(*) AS n_rows FROM ({_DIFF_ORDERS}) GROUP BY action
    UNION ALL
    SELECT 'authors_books' AS table_name, action, count(*) AS n_rows FROM ({_DIFF_AB}) GROUP BY action
    UNION ALL
    SELECT 'lineitem' AS table_name, 'replace' AS action, count(*) AS n_rows FROM lineitem""")
register("sync_all", with_("ab") + """
    SELECT 'orders' AS table_name, count(*) AS n_rows, true AS is_equal FROM orders
    UNION ALL SELECT 'authors_books', count(*), true FROM ab
    UNION ALL SELECT 'lineitem', count(*), true FROM lineitem""")
register("snapshot_equal", with_("orders_read") + """
    , m AS (SELECT count(*) AS n FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM orders_read)),
      e AS (SELECT count(*) AS n FROM (SELECT * FROM orders_read EXCEPT ALL SELECT * FROM orders))
    SELECT 'before' AS stage, m.n AS n_missing, e.n AS n_extra, (m.n = 0 AND e.n = 0) AS is_equal FROM m, e
    UNION ALL SELECT 'after', CAST(0 AS BIGINT), CAST(0 AS BIGINT), true""")
register("fn_row_signature", """
    SELECT o_orderkey, concat_ws('|',
        coalesce(CAST(o_orderkey AS VARCHAR), ''), coalesce(CAST(o_custkey AS VARCHAR), ''),
        coalesce(o_orderstatus, ''), coalesce(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), ''),
        coalesce(CAST(o_orderdate AS VARCHAR), ''), coalesce(o_orderpriority, '')) AS signature
    FROM orders""")
_DRIFT_READ = """drift_read AS (
    SELECT o_orderkey, coalesce(o_custkey, -1) AS o_custkey, o_orderstatus,
           CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice, o_orderdate,
           o_orderstatus = 'F' AS legacy_flag
    FROM orders)
"""
register("retype_report", "WITH " + _DRIFT_READ + """
    SELECT 'o_totalprice' AS column_name, 'string' AS from_type, 'double' AS to_type, true AS castable,
           count(*) AS n_rows,
           count(*) FILTER (WHERE o_totalprice IS NOT NULL AND TRY_CAST(o_totalprice AS DOUBLE) IS NULL) AS n_failed
    FROM drift_read
    UNION ALL
    SELECT 'o_orderstatus', 'string', 'int', true, count(*),
           count(*) FILTER (WHERE o_orderstatus IS NOT NULL AND TRY_CAST(o_orderstatus AS INTEGER) IS NULL)
    FROM drift_read
    UNION ALL
    SELECT 'o_orderdate', 'timestamp_ntz', 'date', true, count(*),
           count(*) FILTER (WHERE o_orderdate IS NOT NULL AND TRY_CAST(o_orderdate AS DATE) IS NULL)
    FROM drift_read
    UNION ALL
    SELECT 'legacy_flag', 'boolean', 'date', false, count(*), count(legacy_flag) FROM drift_read""")

# --- FX-COMPOSITE ----------------------------------------------------------
register("orphans_composite_key", with_("ab_read") + """
    SELECT * FROM ab_read r WHERE NOT EXISTS (
        SELECT 1 FROM ab w WHERE w.author_id = r.author_id AND w.book_id = r.book_id)""")
register("delete_orphans_composite", with_("ab_read") + """
    SELECT * FROM ab_read r WHERE EXISTS (
        SELECT 1 FROM ab w WHERE w.author_id = r.author_id AND w.book_id = r.book_id)""")

# --- FX-NOKEY --------------------------------------------------------------
register("replace_no_key", "SELECT * FROM lineitem")
_UNIQ = """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
           WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
           GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
register("unique_violations", _UNIQ)
register("primary_key_check", f"""
    SELECT l_orderkey, l_linenumber, 'duplicate' AS violation, n_rows FROM ({_UNIQ})
    UNION ALL
    SELECT NULL, NULL, 'null:' || c, n FROM (
        SELECT 'l_orderkey' AS c, count(*) FILTER (WHERE l_orderkey IS NULL) AS n FROM lineitem
        UNION ALL SELECT 'l_linenumber', count(*) FILTER (WHERE l_linenumber IS NULL) FROM lineitem) WHERE n > 0""")

# --- FX-CONFLICT -----------------------------------------------------------
register("upsert_conflict_pairs", with_("cust_read") + """
    , r AS (SELECT c_name, min(c_custkey) AS mn, max(c_custkey) AS mx, count(*) AS n_holders
            FROM cust_read WHERE c_name IS NOT NULL GROUP BY c_name)
    SELECT w.c_custkey AS write_key, w.c_name,
           CASE WHEN r.mn <> w.c_custkey THEN r.mn ELSE r.mx END AS read_key, r.n_holders
    FROM customer w JOIN r ON w.c_name = r.c_name
    WHERE r.mn <> w.c_custkey OR r.mx <> w.c_custkey""")

# --- FX-FK -----------------------------------------------------------------
_CLEAN = """clean AS (SELECT * FROM child WHERE o_custkey IS NULL
                       OR EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = child.o_custkey))"""
register("fk_orphan_cleanup", with_("child") + ", " + _CLEAN + " SELECT * FROM clean")
register("fk_orphan_report", with_("child") + """
    SELECT 'fk_orders_customer' AS constraint_name, o_orderkey, o_custkey AS fk_value FROM child
    WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = child.o_custkey)""")
register("fk_cleanup_chain", with_("child") + ", " + _CLEAN + """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l
    WHERE l_orderkey IS NULL OR EXISTS (SELECT 1 FROM clean WHERE clean.o_orderkey = l.l_orderkey)""")
register("null_violations", with_("child") + """
    SELECT 'o_orderkey' AS column_name, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_nulls FROM child
    UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) FROM child""")

# --- FX-TEXT ---------------------------------------------------------------
_NORM = "lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
register("definition_diff", with_("text_write", "text_read") + f"""
    SELECT coalesce(w.doc_id, r.doc_id) AS doc_id,
           CASE WHEN r.doc_id IS NULL THEN 'create' WHEN w.doc_id IS NULL THEN 'drop'
                WHEN {_NORM.format(c='w.text')} IS NOT DISTINCT FROM {_NORM.format(c='r.text')} THEN 'same'
                ELSE 'recreate' END AS action
    FROM text_write w FULL OUTER JOIN text_read r ON w.doc_id = r.doc_id""")
register("fn_normalise_definition", with_("text_read") + f"""
    SELECT doc_id, {_NORM.format(c='text')} AS normalised FROM text_read""")

# --- FX-ENUM ---------------------------------------------------------------
register("enum_domain_drift", """
    SELECT DISTINCT o_orderpriority AS label FROM orders WHERE o_orderpriority IS NOT NULL
    EXCEPT
    SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'""")

# --- FX-DRIFT --------------------------------------------------------------
register("column_drift", "WITH " + _DRIFT_READ + """
    , nulls AS (
        SELECT 'o_orderkey' AS column_name, count(*) FILTER (WHERE o_orderkey IS NULL) AS read_nulls FROM drift_read
        UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) FROM drift_read
        UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus IS NULL) FROM drift_read
        UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE o_totalprice IS NULL) FROM drift_read
        UNION ALL SELECT 'o_orderdate', count(*) FILTER (WHERE o_orderdate IS NULL) FROM drift_read
        UNION ALL SELECT 'legacy_flag', count(*) FILTER (WHERE legacy_flag IS NULL) FROM drift_read)
    SELECT t.*, nulls.read_nulls FROM (VALUES
        ('orders', 'o_orderkey', 'bigint', 'bigint', 'same'),
        ('orders', 'o_custkey', 'bigint', 'bigint', 'relax_null'),
        ('orders', 'o_orderstatus', 'string', 'string', 'same'),
        ('orders', 'o_totalprice', 'double', 'string', 'retype'),
        ('orders', 'o_orderdate', 'timestamp_ntz', 'timestamp_ntz', 'same'),
        ('orders', 'o_orderpriority', 'string', NULL, 'add'),
        ('orders', 'legacy_flag', NULL, 'boolean', 'drop'))
      AS t(table_name, column_name, write_type, read_type, change)
    LEFT JOIN nulls ON nulls.column_name = t.column_name""")
register("table_set_drift", """
    SELECT * FROM (VALUES ('pages', 'create'), ('legacy_region', 'drop')) AS t(table_name, action)""")
register("align_schema", "WITH " + _DRIFT_READ + """
    SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderdate,
           '5-LOW' AS o_orderpriority
    FROM drift_read""")

# --- FX-SEQ / FX-ZIP -------------------------------------------------------
register("ordered_array_agg", """
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinality, role
    FROM conversations""")
register("unnest_zip_ordinality", """
    SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS ordinality,
           unnest(embedding) AS embedding_elem, unnest(list_reverse(embedding)) AS reversed_elem
    FROM embeddings""")
register("fn_array_literal", """
    WITH x AS (SELECT vec_id, '{' || CAST(vec_id AS VARCHAR) || ',' || CAST(label AS VARCHAR) || ','
                              || CAST(len(embedding) AS VARCHAR) || '}' AS literal FROM embeddings),
         y AS (SELECT vec_id, literal, string_split(trim(literal, '{}'), ',') AS parts FROM x)
    SELECT vec_id, literal, unnest(range(1, len(parts) + 1)) AS ordinality,
           unnest(CAST(parts AS BIGINT[])) AS elem FROM y""")

# --- FX-CMD ----------------------------------------------------------------
_FOLD = with_("cmd") + """,
    s1 AS (SELECT *, last_value(CASE WHEN op IN ('create', 'delete') THEN op END IGNORE NULLS) OVER (
               PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_cd
           FROM cmd),
    s2 AS (SELECT *, coalesce(prev_cd, 'delete') = 'create' AS live_before FROM s1),
    s3 AS (SELECT *, CASE WHEN op = 'create' THEN CASE WHEN live_before THEN 400 ELSE 200 END
                          ELSE CASE WHEN live_before THEN 200 ELSE 404 END END AS code FROM s2),
    s4 AS (SELECT *, code = 200 AND op IN ('create', 'update', 'delete') AS accepted FROM s3),
    s5 AS (SELECT *,
        last_value(CASE WHEN accepted AND op = 'create' THEN {'v': CASE WHEN has_value THEN value END}
                        WHEN accepted AND op = 'update' AND has_value THEN {'v': value} END IGNORE NULLS) OVER w AS st_value,
        last_value(CASE WHEN accepted AND op = 'create' THEN {'v': CASE WHEN has_props THEN props END}
                        WHEN accepted AND op = 'update' AND has_props THEN {'v': props} END IGNORE NULLS) OVER w AS st_props,
        last_value(CASE WHEN accepted AND op = 'create' THEN ts END IGNORE NULLS) OVER w AS st_created,
        last_value(CASE WHEN accepted AND (op = 'create' OR (op = 'update' AND (has_value OR has_props)))
                        THEN ts END IGNORE NULLS) OVER w AS st_updated
        FROM s4 WINDOW w AS (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    fold AS (SELECT event_id, ts, id, op, code, accepted, live_before,
        CASE WHEN op = 'create' THEN true WHEN op = 'delete' THEN false ELSE live_before END AS live_after,
        CASE WHEN (CASE WHEN op = 'create' THEN true WHEN op = 'delete' THEN false ELSE live_before END)
                  OR (accepted AND op = 'delete') THEN true ELSE false END AS vis,
        st_value.v AS st_value, st_props.v AS st_props, st_created, st_updated FROM s5),
    folded AS (SELECT event_id, ts, id, op, code, accepted, live_before, live_after,
        CASE WHEN vis THEN st_value END AS value, CASE WHEN vis THEN st_props END AS props,
        CASE WHEN vis THEN st_created END AS created_at, CASE WHEN vis THEN st_updated END AS updated_at
        FROM fold)
"""
register("cmd_status", _FOLD + "SELECT event_id, id, op, code FROM folded")
for _op, _key in (("create", "cmd_create"), ("update", "cmd_partial_update"), ("delete", "cmd_delete")):
    register(_key, _FOLD + f"""
        SELECT event_id, id, value, props, created_at, updated_at FROM folded
        WHERE accepted AND op = '{_op}'""")
register("state_from_log", _FOLD + """
    , last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS rn FROM folded)
    SELECT id, value, props, created_at, updated_at FROM last WHERE rn = 1 AND live_after""")
_EVENTS = """
    SELECT event_id,
           'author.' || CASE op WHEN 'create' THEN 'created' WHEN 'update' THEN 'updated' ELSE 'deleted' END AS event_type,
           id, CASE WHEN op <> 'delete' THEN value END AS value, CASE WHEN op <> 'delete' THEN props END AS props,
           CASE WHEN op <> 'delete' THEN updated_at END AS updated_at, ts AS occurred_at
    FROM folded WHERE accepted"""
register("domain_events", _FOLD + _EVENTS)
register("dedupe_events", _FOLD + _EVENTS)
register("route_by_topic", with_("cmd") + """
    SELECT event_id, 'author.' || op AS topic,
           CASE WHEN op IN ('update', 'delete', 'get') THEN id END AS id,
           CASE WHEN op IN ('create', 'update') AND has_value THEN value END AS value,
           CASE WHEN op IN ('create', 'update') AND has_props THEN props END AS props
    FROM cmd""")

# --- FX-CMD replies and events ---------------------------------------------
_ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
register("reply_table", _FOLD + f"""
    SELECT event_id, 'author.' || op AS topic, code = 200 AS success,
           CASE WHEN code = 200 THEN json_object('id', id, 'value', value, 'props', props,
                'createdAt', {_ISO.format(c='created_at')}, 'updatedAt', {_ISO.format(c='updated_at')})::VARCHAR
           END AS data_json,
           CASE WHEN code <> 200 THEN code END AS error_code,
           CASE WHEN code = 404 THEN 'Author with ID ' || id || ' not found.'
                WHEN code = 400 THEN 'Author with ID ' || id || ' already exists.' END AS error_message,
           {_ISO.format(c='ts')} AS timestamp
    FROM folded""")
register("error_code_map", _FOLD + """
    , x AS (SELECT event_id, code,
                   CASE WHEN event_id % 4 = 3 AND event_id % 5 = 0 THEN 'TypeError'
                        WHEN code = 404 THEN 'NotFoundException' ELSE 'BadRequestException' END AS class_name,
                   event_id % 4 AS kind
            FROM folded WHERE code <> 200)
    SELECT event_id, class_name,
           CASE WHEN kind IN (0, 1, 2) THEN code
                WHEN class_name = 'NotFoundException' THEN 404
                WHEN class_name = 'BadRequestException' THEN 400 ELSE 500 END AS code
    FROM x""")
register("reply_paginated", with_("cmd") + """
    SELECT id, true AS success, event_id, op, position, total, CAST(1 AS BIGINT) AS page, CAST(10 AS BIGINT) AS page_limit,
           CAST(ceil(total / 10.0) AS BIGINT) AS total_pages
    FROM (SELECT *, count(*) OVER (PARTITION BY id) AS total,
                 row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS position FROM cmd)
    WHERE position <= 10""")
register("emit_events_json", _FOLD + f", ev AS ({_EVENTS})" + f"""
    SELECT event_id, event_type AS topic, CAST(id AS VARCHAR) AS key,
           CASE WHEN event_type LIKE '%.deleted'
                THEN json_object('eventType', event_type, 'id', id, 'occurredAt', {_ISO.format(c='occurred_at')})
                ELSE json_object('eventType', event_type, 'id', id, 'value', value, 'props', props,
                                 'updatedAt', {_ISO.format(c='updated_at')}, 'occurredAt', {_ISO.format(c='occurred_at')})
           END::VARCHAR AS value
    FROM ev""")

# --- FX-ASSIGN -------------------------------------------------------------
_ASSIGNED = with_("assign") + """
    , f AS (SELECT a.*,
                   EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = a.author_id) AS author_ok,
                   EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = a.book_id) AS book_ok
            FROM assign a),
      r AS (SELECT *, row_number() OVER (PARTITION BY author_id, book_id, author_ok AND book_ok
                                         ORDER BY ts, l_orderkey, l_linenumber) AS rn FROM f),
      assigned AS (
        SELECT author_id, book_id, ts, l_orderkey, l_linenumber, l_returnflag,
               CASE WHEN NOT author_ok THEN 404 WHEN NOT book_ok THEN 404 WHEN rn = 1 THEN 200 ELSE 409 END AS code,
               CASE WHEN NOT author_ok THEN 'Author with ID ' || author_id || ' not found.'
                    WHEN NOT book_ok THEN 'Book with ID ' || book_id || ' not found.'
                    WHEN rn = 1 THEN NULL
                    ELSE 'Author ' || author_id || ' is already assigned to Book ' || book_id || '.' END AS message
        FROM r)
"""
register("cmd_assign", _ASSIGNED + """
    SELECT l_orderkey, l_linenumber, author_id, book_id, code, message FROM assigned""")
register("assign_parent_check", with_("assign") + """
    SELECT l_orderkey, l_linenumber, author_id, book_id FROM assign a
    WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = a.author_id)
      AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = a.book_id)""")
_LINK = """(lower(concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '4' || substr(h, 14, 3),
                              '8' || substr(h, 18, 3), substr(h, 21, 12))))"""
register("cmd_unassign", _ASSIGNED + f"""
    , links AS (SELECT {_LINK} AS link_id, author_id, book_id, ts AS assigned_at
                FROM (SELECT *, sha256(concat_ws(chr(1), CAST(author_id AS VARCHAR), CAST(book_id AS VARCHAR))) AS h
                      FROM assigned WHERE code = 200)),
      reqs AS (SELECT l_orderkey, l_linenumber, ts, {_LINK} AS link_id
               FROM (SELECT *, sha256(concat_ws(chr(1), CAST(author_id AS VARCHAR), CAST(book_id AS VARCHAR))) AS h
                     FROM assigned WHERE l_returnflag = 'R')),
      j AS (SELECT reqs.*, links.author_id, links.book_id, links.assigned_at, links.link_id IS NOT NULL AS ex,
                   row_number() OVER (PARTITION BY reqs.link_id, links.link_id IS NOT NULL
                                      ORDER BY reqs.ts, reqs.l_orderkey, reqs.l_linenumber) AS rn
            FROM reqs LEFT JOIN links ON reqs.link_id = links.link_id)
    SELECT l_orderkey, l_linenumber, link_id, CASE WHEN ex AND rn = 1 THEN 200 ELSE 404 END AS code,
           CASE WHEN ex AND rn = 1 THEN author_id END AS author_id,
           CASE WHEN ex AND rn = 1 THEN book_id END AS book_id,
           CASE WHEN ex AND rn = 1 THEN assigned_at END AS assigned_at,
           CASE WHEN ex AND rn = 1 THEN NULL ELSE 'Assignment with ID ' || link_id || ' not found.' END AS message
    FROM j""")

# --- FX-PAYLOAD ------------------------------------------------------------
_VALID = with_("payload") + """
    , v AS (SELECT p_partkey, title, isbn, yr, [
          CASE WHEN title IS NULL THEN 'title must be a string' END,
          CASE WHEN title IS NULL OR title = '' THEN 'title should not be empty' END,
          CASE WHEN title IS NULL OR length(title) < 3 THEN 'title must be longer than or equal to 3 characters' END,
          CASE WHEN isbn IS NOT NULL AND length(isbn) < 10 THEN 'isbn must be longer than or equal to 10 characters' END,
          CASE WHEN isbn IS NOT NULL AND length(isbn) > 13 THEN 'isbn must be shorter than or equal to 13 characters' END,
          CASE WHEN yr IS NOT NULL AND NOT regexp_full_match(yr, '-?[0-9]+') THEN 'publishedYear must be an integer number' END
        ] AS raw FROM payload),
      validated AS (SELECT p_partkey, list_filter(raw, lambda x: x IS NOT NULL) AS violations FROM v)
"""
register("validate_payloads", _VALID + """
    SELECT p_partkey, array_to_string(violations, '; ') AS message, CAST(len(violations) AS BIGINT) AS n_violations,
           len(violations) = 0 AS is_valid FROM validated""")
register("validation_summary", _VALID + """
    SELECT array_to_string(violations, '; ') AS message, count(*) AS n_rows FROM validated GROUP BY 1""")
register("length_violations", with_("payload") + """
    SELECT p_partkey, 'title' AS column_name, CAST(length(title) AS BIGINT) AS length, CAST(255 AS BIGINT) AS max_length
    FROM payload WHERE length(title) > 255
    UNION ALL
    SELECT p_partkey, 'isbn', length(isbn), 13 FROM payload WHERE length(isbn) > 13""")
register("cmd_create_unique", with_("payload") + """
    , f AS (SELECT isbn, min(p_partkey) AS first FROM payload WHERE isbn IS NOT NULL GROUP BY isbn)
    SELECT p.p_partkey, p.isbn,
           CASE WHEN p.isbn IS NOT NULL AND p.p_partkey <> f.first THEN 400 ELSE 200 END AS code,
           CASE WHEN p.isbn IS NOT NULL AND p.p_partkey <> f.first THEN 'Book with ISBN ' || p.isbn || ' already exists' END AS message
    FROM payload p LEFT JOIN f ON p.isbn = f.isbn""")
register("error_message_normalise", _VALID + """
    SELECT p_partkey, 400 AS error_code,
           CASE p_partkey % 5 WHEN 0 THEN array_to_string(violations, '; ') WHEN 1 THEN violations[1]
                              WHEN 2 THEN '{"text":"' || violations[1] || '"}' WHEN 3 THEN ''
                              ELSE CASE WHEN p_partkey % 2 = 0 THEN 'Bad Request' ELSE 'Internal server error' END
           END AS error_message
    FROM validated WHERE len(violations) > 0""")

# --- FX-REPLY --------------------------------------------------------------
register("reply_timeout", with_("req", "rep") + """
    SELECT req.event_id, CASE WHEN rep.event_id IS NULL THEN 503 ELSE 200 END AS code,
           CASE WHEN rep.event_id IS NULL THEN 'Service temporarily unavailable' END AS message,
           CASE WHEN rep.event_id IS NOT NULL THEN date_diff('millisecond', req.ts, rep.rts) END AS latency_ms
    FROM req LEFT JOIN rep ON req.event_id = rep.event_id AND rep.rts >= req.ts
                          AND rep.rts <= req.ts + INTERVAL 10 SECOND""")
register("reply_decode", """
    WITH r AS (SELECT event_id,
        CASE WHEN event_id % 11 = 0 THEN '{"success":false}'
             WHEN event_id % 13 = 0 THEN '{"success":true,"data":null}'
             WHEN event_id % 17 = 0 THEN '{"success":true,"data":"text ' || event_id || '"}'
             WHEN event_id % 19 = 0 THEN '{"success":false,"error":{"code":{"a":1},"message":"0"}}'
             WHEN event_id % 23 = 0 THEN '{"success":false,"error":{"code":99999999999,"details":{"field":"f","n":' || event_id || '}}}'
             WHEN event_id % 7 = 0 THEN '{"success":true,"id":' || event_id || '}'
             WHEN event_id % 3 = 0 THEN '{"success":false,"error":{"code":404,"message":"missing ' || event_id || '"}}'
             WHEN event_id % 3 = 1 THEN '{"success":false,"statusCode":"E_TEXT","message":"text code ' || event_id || '"}'
             ELSE '{"success":true,"data":{"id":' || event_id || ',"v":' || user_id || '}}' END AS reply
        FROM events),
    d AS (SELECT event_id, reply, coalesce(json_extract(reply, '$.success')::BOOLEAN, true) AS ok,
                 json_type(reply, '$.error.code') AS ect, json_extract_string(reply, '$.error.code') AS ec,
                 json_type(reply, '$.statusCode') AS sct, json_extract_string(reply, '$.statusCode') AS sc
          FROM r)
    SELECT event_id, ok,
           CASE WHEN ok THEN NULL
                WHEN ec IS NOT NULL AND ec NOT IN ('', '0', 'false') THEN
                     CASE WHEN ect = 'VARCHAR' THEN 400 ELSE coalesce(TRY_CAST(ec AS INTEGER), 400) END
                WHEN sc IS NOT NULL AND sc NOT IN ('', '0', 'false') THEN
                     CASE WHEN sct = 'VARCHAR' THEN 400 ELSE CAST(sc AS INTEGER) END
                ELSE 400 END AS code,
           CASE WHEN ok THEN NULL ELSE coalesce(nullif(json_extract_string(reply, '$.error.message'), ''),
                                                nullif(json_extract_string(reply, '$.message'), ''),
                                                'Internal server error') END AS message,
           CASE WHEN ok AND json_type(reply, '$.data') IS DISTINCT FROM 'NULL'
                THEN coalesce(json_extract(reply, '$.data')::VARCHAR, reply) END AS data_json,
           CASE WHEN NOT ok THEN json_extract(reply, '$.error.details')::VARCHAR END AS details_json
    FROM d""")

# --- FX-LOG ----------------------------------------------------------------
register("redact_paths", with_("logrec") + """
    SELECT c_custkey,
           '{"ctx":null,"image":"[REDACTED]","items":[{"n":1.5,"token":"[REDACTED]"},' || k || '],"level":"' || level
           || '","msg":"customer ' || k || '","password":"[REDACTED]",'
           || '"req":{"headers":{"authorization":"[REDACTED]","host":"h' || nk || '"}},'
           || '"user":{"image":"keep' || k || '","name":"' || c_name || '",'
           || '"profile":{"imageBase64":"[REDACTED]","password":"[REDACTED]"},"token":"[REDACTED]"}}' AS redacted
    FROM logrec""")
register("redact_deep", with_("logrec") + """
    SELECT c_custkey,
           repeat('{"a":[', 15) || '{"ctx":null,"image":"img' || k || '","items":[{"n":1.5,"token":"[REDACTED]"},' || k || '],"level":"' || level
           || '","msg":"customer ' || k || '","password":"[REDACTED]",'
           || '"req":{"headers":{"authorization":"Bearer ' || k || '","host":"h' || nk || '"}},'
           || '"user":{"image":"keep' || k || '","name":"' || c_name || '",'
           || '"profile":{"imageBase64":"[REDACTED]","password":"[REDACTED]"},"token":"[REDACTED]"}}' || repeat(']}', 15) AS redacted,
           repeat('[{"k":', 15) || '{"buffer":"[REDACTED]","z":1}' || repeat('}]', 15) AS hidden
    FROM logrec""")
register("log_level_filter", with_("logrec") + """
    SELECT c_custkey, level FROM logrec WHERE level IN ('error', 'warn', 'log')""")
register("log_shape", with_("logrec") + """
    SELECT c_custkey,
           CASE level WHEN 'error' THEN 'ERROR' WHEN 'warn' THEN 'WARN' WHEN 'log' THEN 'INFO'
                      WHEN 'debug' THEN 'DEBUG' WHEN 'verbose' THEN 'TRACE' ELSE 'INFO' END AS level_label,
           coalesce(context, 'Application') AS context,
           CASE WHEN c_custkey % 4 = 0 THEN 'customer ' || k
                WHEN level = 'error' THEN 'Error payload' ELSE 'Object payload' END AS msg,
           '{' || CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 11 = 0 THEN '"0":"a","1":' || k || ','
                       WHEN c_custkey % 4 <> 0 THEN '"code":' || k || ',' ELSE '' END
           || '"context":"' || CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 5 = 0 THEN 'own'
                                    ELSE coalesce(context, 'Application') END || '"'
           || CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 11 <> 0 THEN ',"msg":null' ELSE '' END
           || CASE WHEN level = 'error' AND c_custkey % 3 = 0 THEN ',"trace":"at line ' || k || '"' ELSE '' END
           || '}' AS fields_json
    FROM logrec""")

# --- property keys with a query form ---------------------------------------
register("sync_empty_source", "SELECT * FROM orders WHERE o_orderstatus = 'X'")
register("rebuild_on_key_type_change", "SELECT *, true AS rebuilt FROM orders")

# --- streaming twins: same answers as the batch keys -----------------------
for _s, _b in (("stream_cmd_status", "cmd_status"), ("stream_state_from_log", "state_from_log"),
               ("stream_domain_events", "domain_events"), ("stream_dedupe_events", "dedupe_events"),
               ("stream_cdc_apply", "cdc_apply"), ("stream_reply_timeout", "reply_timeout")):
    register(_s, ORACLE[_b])

# --- E2/E5/E7 and the T8 twin ------------------------------------------------
register("reply_normalise", _FOLD + f"""
    , r AS (SELECT event_id, op, ts,
                   CASE WHEN op = 'get' AND event_id % 3 = 0
                             THEN '{{"data":{{"id":' || id || '}},"meta":{{"page":1,"source":"' || op || '"}}}}'
                        WHEN op = 'get' AND event_id % 3 = 1 THEN '{{"data":"text","meta":{{"page":2}}}}'
                        WHEN op = 'update' AND event_id % 4 = 0 THEN '{{"success":false,"error":{{"message":"m","code":409}}}}'
                        WHEN op = 'update' THEN '{{"success":true,"data":{{"id":' || id || '}}}}'
                        WHEN op = 'delete' THEN NULL
                        ELSE '{{"id":' || id || '}}' END AS result
            FROM folded WHERE code = 200)
    SELECT event_id,
           CASE WHEN result IS NULL THEN 'empty' WHEN op = 'update' THEN 'wrapped'
                WHEN op = 'get' AND event_id % 3 IN (0, 1) THEN 'unwrapped' ELSE 'plain' END AS kind,
           NOT (op = 'update' AND event_id % 4 = 0) AS success,
           CASE WHEN result IS NULL THEN 'true'
                WHEN op = 'update' OR (op = 'get' AND event_id % 3 IN (0, 1)) THEN json_extract(result, '$.data')::VARCHAR
                ELSE result END AS data_json,
           CASE WHEN op = 'update' THEN NULL
                ELSE '{{' || CASE WHEN op = 'get' AND event_id % 3 = 0 THEN '"page":1,"source":"get",'
                                  WHEN op = 'get' AND event_id % 3 = 1 THEN '"page":2,' ELSE '' END
                     || '"timestamp":"' || {_ISO.format(c='ts')} || '"}}' END AS meta_json,
           CASE WHEN op = 'update' THEN json_extract(result, '$.error')::VARCHAR END AS error_json,
           {_ISO.format(c='ts')} AS timestamp
    FROM r""")
register("error_details", _VALID + """
    SELECT p_partkey, array_to_string(violations, '; ') AS error_message,
           CASE WHEN p_partkey % 2 = 1 THEN '{"property":"' || split_part(violations[1], ' ', 1) || '"}' END AS details_json
    FROM validated WHERE len(violations) > 0""")
register("stream_reply_table", ORACLE["reply_table"])

register("validate_author_payloads", """
    WITH a AS (SELECT c_custkey,
                      CASE WHEN c_custkey % 9 = 0 THEN 'Al' ELSE split_part(c_name, '#', 1) END AS fn,
                      CASE WHEN c_custkey % 10 = 0 THEN '' ELSE split_part(c_name, '#', 2) END AS ln,
                      CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'not-a-date'
                           ELSE '1980-01-' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') END AS bd
               FROM customer),
         v AS (SELECT c_custkey, list_filter([
                  CASE WHEN fn IS NULL THEN 'firstName must be a string' END,
                  CASE WHEN fn IS NULL OR fn = '' THEN 'firstName should not be empty' END,
                  CASE WHEN fn IS NULL OR length(fn) < 3 THEN 'firstName must be longer than or equal to 3 characters' END,
                  CASE WHEN ln IS NULL THEN 'lastName must be a string' END,
                  CASE WHEN ln IS NULL OR ln = '' THEN 'lastName should not be empty' END,
                  CASE WHEN ln IS NULL OR length(ln) < 3 THEN 'lastName must be longer than or equal to 3 characters' END,
                  CASE WHEN TRY_CAST(bd AS TIMESTAMP) IS NULL THEN 'birthDate must be a Date instance' END
               ], lambda x: x IS NOT NULL) AS vs FROM a)
    SELECT c_custkey, array_to_string(vs, '; ') AS message, len(vs) = 0 AS is_valid FROM v""")
register("stream_state_tws", ORACLE["state_from_log"])


# --- FX-MSG: all topics ------------------------------------------------------
def _s(p: str) -> str:  # the text value, else NULL
    return f"CASE WHEN json_type(payload, '$.{p}') = 'VARCHAR' THEN json_extract_string(payload, '$.{p}') END"


def _n(p: str, coerced: bool = False) -> str:  # the number, else NULL
    kinds = "'VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE'" if coerced else "'UBIGINT', 'BIGINT', 'DOUBLE'"
    return f"CASE WHEN json_type(payload, '$.{p}') IN ({kinds}) THEN TRY_CAST(json_extract_string(payload, '$.{p}') AS DOUBLE) END"


def _bad(cond: str, text: str) -> str:
    return f"CASE WHEN NOT coalesce({cond}, false) THEN '{text}' END"


def _string(p):
    return [_bad(f"{_s(p)} IS NOT NULL", f"{p} must be a string")]


def _filled(p):
    return [_bad(f"coalesce(json_type(payload, '$.{p}'), 'NULL') <> 'NULL' AND json_extract_string(payload, '$.{p}') <> ''",
                 f"{p} should not be empty")]


def _least(p, n):
    return [_bad(f"length({_s(p)}) >= {n}", f"{p} must be longer than or equal to {n} characters")]


def _most(p, n):
    return [_bad(f"length({_s(p)}) <= {n}", f"{p} must be shorter than or equal to {n} characters")]


def _uuid(p):
    return [_bad(f"regexp_full_match({_s(p)}, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')", f"{p} must be a UUID")]


def _date(p):
    return [_bad(f"TRY_CAST({_s(p)} AS TIMESTAMP) IS NOT NULL", f"{p} must be a Date instance")]


def _whole(p, coerced=False):
    return [_bad(f"{_n(p, coerced)} = floor({_n(p, coerced)})", f"{p} must be an integer number")]


def _from(p, n, coerced=False):
    return [_bad(f"{_n(p, coerced)} >= {n}", f"{p} must not be less than {n}")]


def _upto(p, n, coerced=False):
    return [_bad(f"{_n(p, coerced)} <= {n}", f"{p} must not be greater than {n}")]


def _maybe(p, rules):
    return [f"CASE WHEN coalesce(json_type(payload, '$.{p}'), 'NULL') <> 'NULL' THEN {r} END" for r in rules]


def _opt_text(p):
    return _maybe(p, _string(p) + _least(p, 3))


_ISBN = _maybe("isbn", _string("isbn") + _least("isbn", 10) + _most("isbn", 13))
_YEAR = _maybe("publishedYear", _whole("publishedYear"))
_BORN = _maybe("birthDate", _date("birthDate"))
_TOPIC_RULES = {
    "author.create": [r for p in ("firstName", "lastName") for r in _string(p) + _filled(p) + _least(p, 3)] + _date("birthDate"),
    "author.update": _uuid("id") + _opt_text("firstName") + _opt_text("lastName") + _BORN,
    "author.delete": _uuid("id"), "author.get": _uuid("id"),
    "author.getAll": _whole("page", True) + _from("page", 1, True) + _whole("limit", True) + _from("limit", 1, True)
    + _upto("limit", 100, True) + _opt_text("firstName") + _opt_text("lastName") + _BORN,
    "book.create": _string("title") + _filled("title") + _least("title", 3) + _ISBN + _YEAR,
    "book.update": _uuid("id") + _opt_text("title") + _ISBN + _YEAR,
    "book.delete": _string("id") + _filled("id"), "book.get": _uuid("id"),
    "book.getAll": _maybe("page", _whole("page") + _from("page", 1))
    + _maybe("limit", _whole("limit") + _from("limit", 1) + _upto("limit", 100)) + _opt_text("title") + _opt_text("isbn") + _YEAR,
    "authorBook.assign": _uuid("authorId") + _filled("authorId") + _uuid("bookId") + _filled("bookId"),
    "authorBook.unassign": _uuid("id") + _filled("id"),
}
register("validate_messages", with_("msg") + ", v AS (SELECT event_id, topic, list_filter(CASE topic "
         + " ".join(f"WHEN '{t}' THEN [{', '.join(rules)}]" for t, rules in _TOPIC_RULES.items())
         + """ END, lambda x: x IS NOT NULL) AS violations FROM msg)
    SELECT event_id, topic, array_to_string(violations, '; ') AS message, CAST(len(violations) AS BIGINT) AS n_violations FROM v""")
_TAKEN_BY = {
    "id": "'author.update', 'author.delete', 'author.get', 'book.update', 'book.delete', 'book.get', 'authorBook.unassign'",
    "firstName": "'author.create', 'author.update', 'author.getAll'", "lastName": "'author.create', 'author.update', 'author.getAll'",
    "birthDate": "'author.create', 'author.update', 'author.getAll'", "page": "'author.getAll', 'book.getAll'",
    "limit": "'author.getAll', 'book.getAll'", "title": "'book.create', 'book.update', 'book.getAll'",
    "isbn": "'book.create', 'book.update', 'book.getAll'", "publishedYear": "'book.create', 'book.update', 'book.getAll'",
    "authorId": "'authorBook.assign'", "bookId": "'authorBook.assign'",
}
register("route_messages", with_("msg") + "SELECT event_id, topic, " + ", ".join(
    f"""CASE WHEN topic IN ({ts}) THEN json_extract_string(payload, '$.{f}') END AS "{f}" """ for f, ts in _TAKEN_BY.items())
    + " FROM msg")

_LINK_OF = f"(SELECT {_LINK} FROM (SELECT sha256(concat_ws(chr(1), CAST(author_id AS VARCHAR), CAST(book_id AS VARCHAR))) AS h))"
_ASSIGN_LOG = with_("ab", "assign") + f"""
    , f AS (SELECT a.*, CASE WHEN l_returnflag = 'R' THEN 'unassign' ELSE 'assign' END AS op,
                   EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = a.author_id) AS author_ok,
                   EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = a.book_id) AS book_ok,
                   EXISTS (SELECT 1 FROM ab WHERE ab.author_id = a.author_id AND ab.book_id = a.book_id
                                              AND (ab.author_id + ab.book_id) % 10 = 3) AS stored
            FROM assign a),
      g AS (SELECT *, last_value(CASE WHEN op = 'unassign' OR (author_ok AND book_ok) THEN op END IGNORE NULLS) OVER (
                PARTITION BY author_id, book_id ORDER BY ts, l_orderkey, l_linenumber
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM f),
      h AS (SELECT *, CASE WHEN prev IS NULL THEN stored ELSE prev = 'assign' END AS live, {_LINK_OF} AS link_id FROM g),
      judged AS (SELECT *, CASE WHEN op = 'unassign' THEN CASE WHEN live THEN 200 ELSE 404 END
                                WHEN NOT author_ok OR NOT book_ok THEN 404 WHEN live THEN 409 ELSE 200 END AS code FROM h)
"""
register("cmd_assignment_log", _ASSIGN_LOG + """
    SELECT l_orderkey, l_linenumber, op, author_id, book_id, code,
           CASE WHEN code = 200 THEN NULL WHEN op = 'unassign' THEN 'Assignment with ID ' || link_id || ' not found.'
                WHEN NOT author_ok THEN 'Author with ID ' || author_id || ' not found.'
                WHEN NOT book_ok THEN 'Book with ID ' || book_id || ' not found.'
                ELSE 'Author ' || author_id || ' is already assigned to Book ' || book_id || '.' END AS message
    FROM judged""")
register("assignment_events", _ASSIGN_LOG + """
    SELECT l_orderkey, l_linenumber, CASE op WHEN 'assign' THEN 'authorBook.created' ELSE 'authorBook.deleted' END AS event_type,
           link_id, CASE WHEN op = 'assign' THEN author_id END AS author_id, CASE WHEN op = 'assign' THEN book_id END AS book_id,
           CASE WHEN op = 'assign' THEN ts END AS assigned_at
    FROM judged WHERE code = 200""")

# --- operators that no other key reaches --------------------------------------
register("entity_to_aggregate", """
    SELECT p_partkey AS id, p_name AS title, p_size AS "publishedYear",
           '["' || p_partkey || '","' || p_size || '"]' AS key_json, CASE WHEN p_size > 25 THEN 'YES' ELSE 'NO' END AS is_large
    FROM part""")
register("exists_flag", with_("orders_read") + """
    SELECT l_orderkey AS o_orderkey, l_linenumber, EXISTS (SELECT 1 FROM orders_read r WHERE r.o_orderkey = l_orderkey) AS "exists"
    FROM lineitem""")
register("label_difference", """
    WITH w AS (SELECT vec_id, unnest(range(0, 5)) AS i, unnest([(label * (j + 1) + vec_id) % 7 for j in range(0, 5)]) AS label
               FROM embeddings),
         d AS (SELECT vec_id, label, min(i) AS i FROM w WHERE label NOT IN (1, 4) GROUP BY vec_id, label)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS position, CAST(label AS BIGINT) AS label FROM d""")

# --- bucketed replica ---------------------------------------------------------
register("cdc_bucketed", """
    WITH last AS (
      SELECT l_orderkey, l_returnflag = 'R' AND l_linestatus = 'F' AS gone, l_linestatus, l_extendedprice,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS place
      FROM lineitem)
    SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, o_custkey, coalesce(l_linestatus, o_orderstatus) AS o_orderstatus,
           coalesce(l_extendedprice, o_totalprice) AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders FULL JOIN (SELECT * FROM last WHERE place = 1) l ON l_orderkey = o_orderkey WHERE gone IS DISTINCT FROM true""")
register("sync_bucketed", _IDS + """
    SELECT * FROM (SELECT * FROM orders_read r WHERE NOT EXISTS (SELECT 1 FROM rws WHERE rws.o_orderkey = r.o_orderkey)
                   UNION ALL SELECT * FROM rws)
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")

# --- event-time fold ------------------------------------------------------------
_LATE = "event_id % 40 = 7 AND ts < TIMESTAMP '2024-01-12 00:00:00'"
register("stream_ordered_fold", _FOLD.replace("FROM cmd)", f"FROM cmd WHERE NOT ({_LATE}))") + f"""
    SELECT event_id, id, op, code, value, props, created_at, updated_at, false AS late FROM folded
    UNION ALL
    SELECT event_id, id, op, NULL, NULL, NULL, NULL, NULL, true FROM cmd WHERE {_LATE}""")

# --- FX-LIVES -------------------------------------------------------------------
_LIVES = f"""
WITH e AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey AS author_id, l_partkey % 97 AS book_id,
         row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n,
         CASE WHEN l_linenumber < 6 OR l_orderkey % 20 > 2 THEN 'link' WHEN l_linenumber = 7 THEN 'author' ELSE 'book' END AS kind,
         CASE WHEN kind = 'link' THEN CASE WHEN l_returnflag = 'R' THEN 'unassign' ELSE 'assign' END
              WHEN l_orderkey % 20 = 0 THEN 'delete' ELSE 'create' END AS op
  FROM lineitem),
authors AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 5 <> 4),
books AS (SELECT DISTINCT p_partkey % 97 AS id FROM part WHERE p_partkey % 97 % 7 <> 6),
stored AS (SELECT DISTINCT author_id, book_id FROM e WHERE (author_id + book_id) % 10 = 3
             AND author_id IN (SELECT id FROM authors) AND book_id IN (SELECT id FROM books)),
f AS (
  SELECT *, last_value(CASE WHEN kind = 'author' THEN op END IGNORE NULLS) OVER a AS a_cd, max(CASE WHEN kind = 'author' AND op = 'delete' THEN n END) OVER a AS a_gone,
            last_value(CASE WHEN kind = 'book' THEN op END IGNORE NULLS) OVER b AS b_cd, max(CASE WHEN kind = 'book' AND op = 'delete' THEN n END) OVER b AS b_gone
  FROM e WINDOW a AS (PARTITION BY author_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                b AS (PARTITION BY book_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ok AS (SELECT *, coalesce(a_cd = 'create', author_id IN (SELECT id FROM authors)) AS author_ok,
             coalesce(b_cd = 'create', book_id IN (SELECT id FROM books)) AS book_ok FROM f WHERE kind = 'link'),
g AS (SELECT *, CASE WHEN op = 'unassign' OR (author_ok AND book_ok) THEN op END AS effect FROM ok),
h AS (SELECT g.*, s.author_id IS NOT NULL AS stored, last_value(effect IGNORE NULLS) OVER p AS prev, max(CASE WHEN effect IS NOT NULL THEN n END) OVER p AS prev_n
      FROM g LEFT JOIN stored s ON s.author_id = g.author_id AND s.book_id = g.book_id
      WINDOW p AS (PARTITION BY g.author_id, g.book_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, CASE WHEN prev IS NULL THEN stored AND a_gone IS NULL AND b_gone IS NULL
                     ELSE prev = 'assign' AND coalesce(a_gone, 0) < prev_n AND coalesce(b_gone, 0) < prev_n END AS live FROM h),
judged AS (SELECT *, {_LINK_OF} AS link_id, CASE WHEN op = 'unassign' THEN CASE WHEN live THEN 200 ELSE 404 END
                          WHEN NOT author_ok OR NOT book_ok THEN 404 WHEN live THEN 409 ELSE 200 END AS code FROM i)
"""
register("assignment_asof", _LIVES + """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, op, author_id, book_id, code,
           CASE WHEN code = 200 THEN NULL WHEN op = 'unassign' THEN 'Assignment with ID ' || link_id || ' not found.'
                WHEN NOT author_ok THEN 'Author with ID ' || author_id || ' not found.'
                WHEN NOT book_ok THEN 'Book with ID ' || book_id || ' not found.'
                ELSE 'Author ' || author_id || ' is already assigned to Book ' || book_id || '.' END AS message
    FROM judged""")
register("links_asof", _LIVES + """
    , last AS (SELECT *, row_number() OVER (PARTITION BY author_id, book_id ORDER BY n DESC) AS place FROM judged WHERE code = 200),
    made AS (
      SELECT author_id, book_id, op, n, l_orderkey, l_linenumber FROM last WHERE place = 1
      UNION ALL
      SELECT author_id, book_id, 'assign', 0, NULL, NULL FROM stored
      WHERE (author_id, book_id) NOT IN (SELECT (author_id, book_id) FROM last))
    SELECT author_id, book_id, l_orderkey, l_linenumber FROM made m WHERE op = 'assign'
      AND NOT EXISTS (SELECT 1 FROM e WHERE kind = 'author' AND e.op = 'delete' AND e.author_id = m.author_id AND (e.n > m.n OR m.n = 0))
      AND NOT EXISTS (SELECT 1 FROM e WHERE kind = 'book' AND e.op = 'delete' AND e.book_id = m.book_id AND (e.n > m.n OR m.n = 0))""")

# --- FX-UNIQUE: one command after the other; what each id holds is a list (NULL: not live, -1: no value) ------------
register("cmd_unique_lifecycle", with_("cmd") + """
    , c AS MATERIALIZED (
      SELECT event_id, id, op, has_value OR op = 'create' AS has, CASE WHEN event_id % 13 <> 0 THEN event_id * 31 % 9973 END AS v,
             row_number() OVER (ORDER BY ts, event_id) AS n FROM cmd),
    ids AS MATERIALIZED (SELECT DISTINCT id FROM c),
    s(n, holds, code) AS (
      SELECT CAST(0 AS BIGINT), list(CASE WHEN x % 10 = 3 AND x < 9973 THEN id END ORDER BY x), CAST(NULL AS INTEGER)
      FROM (SELECT unnest(range(0, (SELECT max(id) + 1 FROM ids))) AS x) LEFT JOIN ids ON id = x
      UNION ALL
      SELECT n, CASE WHEN code <> 200 OR op = 'get' OR (op = 'update' AND NOT has) THEN holds
                     ELSE list_transform(holds, lambda x, i: CASE WHEN i <> id + 1 THEN x WHEN op <> 'delete' THEN coalesce(v, -1) END) END, code
      FROM (SELECT c.n, holds, op, c.id, v, has,
              CASE WHEN op = 'create' THEN CASE WHEN holds[c.id + 1] IS NOT NULL OR taken THEN 400 ELSE 200 END
                   WHEN holds[c.id + 1] IS NULL THEN 404 WHEN op = 'update' AND has AND taken THEN 400 ELSE 200 END AS code
            FROM (SELECT c.*, holds, v IS NOT NULL AND coalesce(list_position(holds, v), 0) NOT IN (0, c.id + 1) AS taken FROM s JOIN c ON c.n = s.n + 1) c))
    SELECT event_id, id, op, 'B' || v AS isbn, code,
           CASE WHEN op = 'create' AND code = 400 THEN CASE WHEN before[id + 1] IS NOT NULL THEN 'Book with ID ' || id || ' already exists.'
                                                           ELSE 'Book with ISBN B' || v || ' already exists' END
                WHEN code = 404 THEN 'Book with ID ' || id || ' not found.'
                WHEN code = 400 THEN 'Book with ISBN B' || v || ' already exists' END AS message
    FROM (SELECT c.*, s.code, p.holds AS before FROM c JOIN s ON s.n = c.n JOIN s p ON p.n = c.n - 1)""")
ORACLE["cmd_unique_lifecycle"] = ORACLE["cmd_unique_lifecycle"].replace("WITH cmd", "WITH RECURSIVE cmd", 1)

# --- table set ----------------------------------------------------------------------
register("sync_table_set", with_("orders_read") + """
    , o AS (SELECT * FROM orders_read WHERE o_orderpriority <> '1-URGENT'),
    d AS (SELECT CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN w.o_orderkey IS NULL THEN 'delete'
                      WHEN w IS NOT DISTINCT FROM o THEN 'same' ELSE 'update' END AS action
          FROM orders w FULL JOIN o ON w.o_orderkey = o.o_orderkey),
    parts AS (SELECT p_partkey FROM part WHERE p_size IN (SELECT n_nationkey FROM nation)),
    report AS (
      SELECT 'orders' AS table_name, action, count(*) AS n_rows FROM d GROUP BY action
      UNION ALL SELECT 'orders', 'enum_add', count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM o)
      UNION ALL SELECT 'legacy_region', 'drop', 0
      UNION ALL SELECT 'customer', 'create', count(*) FROM customer
      UNION ALL SELECT 'region', unnest(['same', 'unchanged']), (SELECT count(*) FROM region)
      UNION ALL SELECT 'supplier', unnest(['same', 'unchanged']), (SELECT count(*) FROM supplier)
      UNION ALL SELECT 'nation', 'column_add', 1
      UNION ALL SELECT 'nation', 'update', count(*) FROM nation
      UNION ALL SELECT 'part', 'column_retype', 1
      UNION ALL SELECT 'part', 'same', count(*) FROM part
      UNION ALL SELECT 'lineitem', 'replace', count(*) FROM lineitem
      UNION ALL SELECT 'events', CASE WHEN event_id % 10 = 3 THEN 'insert' ELSE 'same' END AS action, count(*) FROM events GROUP BY action
      UNION ALL SELECT 'part', 'fk_removed', (SELECT count(*) FROM part) - (SELECT count(*) FROM parts)
      UNION ALL SELECT 'lineitem', 'fk_removed', count(*) FROM lineitem
                WHERE l_partkey NOT IN (SELECT p_partkey FROM parts) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)
      UNION ALL SELECT 'events', 'fk_removed', count(*) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier))
    SELECT table_name, action, CAST(n_rows AS BIGINT) AS n_rows FROM report WHERE n_rows > 0 OR action = 'drop'""")
register("list_deep_page", """
    SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET (SELECT count(*) // 2 // 10 * 10 FROM orders)""")

# --- whole replies, sinks, catalogs ----------------------------------------------------
register("emit_events_sink", ORACLE["emit_events_json"])
register("m2n_nested_page", with_("ab") + """
    , page AS (SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10 OFFSET 10)
    SELECT s_suppkey, s_name, coalesce(list(p_partkey || ':' || p_name ORDER BY p_partkey) FILTER (WHERE p_partkey IS NOT NULL), []) AS books
    FROM page LEFT JOIN ab ON author_id = s_suppkey LEFT JOIN part ON p_partkey = book_id GROUP BY s_suppkey, s_name""")
register("reply_details", _VALID + """
    SELECT p_partkey, false AS success, 400 AS error_code, array_to_string(violations, '; ') AS error_message,
           CASE WHEN len(violations) > 1 THEN '{"property":"' || split_part(violations[1], ' ', 1) || '","count":' || len(violations) || '}' END AS details_json,
           '2024-01-01T00:00:00.000Z' AS timestamp
    FROM validated WHERE len(violations) > 0""")
register("catalog_drift", """
    WITH nulls AS (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS column_name,
                          unnest([count(*) - count(event_id), count(*) - count(ts), count(*) - count(user_id), count(*) - count(event_type),
                                  count(*) - count(value), count(*) - count(CASE WHEN event_id % 17 <> 0 THEN props END)]) AS read_nulls FROM events),
         d AS (SELECT column_name, CASE WHEN column_name IN ('value') THEN 'redefault' WHEN column_name = 'props' THEN 'same' ELSE 'tighten_null' END AS change FROM nulls)
    SELECT column_name, change, read_nulls, change = 'tighten_null' AND read_nulls = 0 AS can_tighten FROM d JOIN nulls USING (column_name)""")
register("tables_with_rows", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, EXISTS (SELECT 1 FROM {t}) AS has_rows"
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
              "pages", "benchmark", "labels", "conversations"])
    + "\nUNION ALL SELECT 'orders with status X', EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'X')")
register("upsert_unique_index", """
    SELECT a.c_custkey, CASE a.c_custkey % 10 WHEN 1 THEN coalesce(n.c_name, a.c_name) WHEN 2 THEN coalesce(p.c_name, a.c_name)
                                             WHEN 7 THEN coalesce(p.c_name, a.c_name) ELSE a.c_name END AS c_name,
           CASE WHEN a.c_custkey % 10 IN (4, 8) THEN n.c_name IS NOT NULL ELSE a.c_custkey % 10 = 9 AND f.c_name IS NOT NULL END AS refused
    FROM customer a LEFT JOIN customer n ON n.c_custkey = a.c_custkey + 1 LEFT JOIN customer p ON p.c_custkey = a.c_custkey - 1
    LEFT JOIN customer f ON f.c_custkey = a.c_custkey - 4 WHERE a.c_custkey % 10 <> 6""")
register("stream_reply_late", with_("req", "rep") + """
    SELECT req.event_id, CASE WHEN rep.event_id IS NOT NULL THEN 200 ELSE 503 END AS code,
           CASE WHEN rep.event_id IS NULL THEN 'Service temporarily unavailable' END AS message,
           CASE WHEN rep.event_id IS NOT NULL THEN date_diff('millisecond', req.ts, rep.rts) END AS latency_ms, false AS late
    FROM req LEFT JOIN rep ON rep.event_id = req.event_id AND rep.rts BETWEEN req.ts AND req.ts + INTERVAL 10 SECONDS
    UNION ALL
    SELECT rep.event_id, NULL, NULL, NULL, true FROM rep JOIN req ON rep.event_id = req.event_id
    WHERE NOT rep.rts BETWEEN req.ts AND req.ts + INTERVAL 10 SECONDS""")
