"""Queries over the tables, one or more for each operator, and the DuckDB SQL that gives the same rows.

Ciphertext is random, so queries return plaintext, index bytes or facts of the
headers. Customers are encrypted under three key versions where rotation
matters: version = c_custkey % 3 + 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.envelope import FIXED_OVERHEAD, NONCE_BYTES, TAG_BYTES, from_text, is_envelope, parse
from veilframe.operators import codec, migrate, search, write
from veilframe.plans.audit import audit
from veilframe.plans.lint import lint_frame
from veilframe.plans.spec import Catalogue, EntitySpec
from veilframe.sources.keys import LocalKeyProvider
from veilframe.sources.store import table, written

TENANT = "acme"
ROOTS = {1: b"\x11" * 32, 2: b"\x22" * 32, 3: b"\x33" * 32}
PROVIDER = LocalKeyProvider(ROOTS, 3)
NEWEST_ONLY = LocalKeyProvider({3: ROOTS[3]}, 3)


def catalogue() -> Catalogue:
    """The entities over the tables."""
    c = Catalogue()
    customer = c.entity("Customer", "c_custkey long, c_name string, email string, c_nationkey int, c_acctbal double, c_mktsegment string, note string").encrypted_entity("customer")
    customer.field("c_name").searchable("name").field("email").email("email").field("c_mktsegment").searchable("segment").field("note").plaintext()
    supplier = c.entity("Supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").encrypted_entity("supplier")
    supplier.field("s_name").encrypted("name")
    orders = c.entity("Order", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").encrypted_entity("order")
    orders.field("o_orderpriority").encrypted("priority")
    page = c.entity("Page", "page_id long, url string, html binary").encrypted_entity("page")
    page.field("html").encrypted("html").field("url").plaintext()
    document = c.entity("Document", "doc_id long, text string, lang string, source string, n_chars long").encrypted_entity("document")
    document.field("text").encrypted("text").field("lang").plaintext().field("source").plaintext()
    conversation = c.entity("Conversation", "conv_id long, turn long, role string, text string").encrypted_entity("conversation")
    conversation.field("text").encrypted("text").field("role").plaintext()
    return c.finish()


CATALOGUE = catalogue()
CUSTOMER = CATALOGUE["Customer"]


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("email", F.concat(F.lower("c_name"), F.lit("@example.com"))).withColumn("note", F.lit("customer")).select(*CUSTOMER.schema.names)


def stored(df: DataFrame, spec: EntitySpec, name: str) -> DataFrame:
    """df in stored form under the current version, written and read, since each evaluation would draw new nonces."""
    return written(codec.encrypt(df, spec, PROVIDER, TENANT), name)


def stored_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under the three versions."""
    plain = customers(spark, sf_dir)
    parts = [codec.encrypt(plain.where(F.col("c_custkey") % 3 == v - 1), CUSTOMER, PROVIDER, TENANT, key_id=PROVIDER.key_id(TENANT, v)) for v in ROOTS]
    return written(reduce(DataFrame.unionByName, parts), "customers")


def _opened(df: DataFrame) -> DataFrame:
    return codec.decrypt(df, CUSTOMER, PROVIDER, TENANT).select("c_custkey", "c_name")


def roundtrip_string(spark, sf_dir):
    return codec.decrypt(stored(customers(spark, sf_dir), CUSTOMER, "customers"), CUSTOMER, PROVIDER, TENANT).select("c_custkey", "c_name", "email", "c_mktsegment", "c_acctbal")


def roundtrip_binary(spark, sf_dir):
    spec = CATALOGUE["Page"]
    pages = table(spark, sf_dir, "pages").withColumn("html", F.encode("html", "UTF-8"))
    back = codec.decrypt(stored(pages, spec, "pages"), spec, PROVIDER, TENANT)
    return back.select("page_id", F.md5("html").alias("html_md5"), F.octet_length("html").cast("long").alias("bytes"))


def roundtrip_documents(spark, sf_dir):
    spec = CATALOGUE["Document"]
    back = codec.decrypt(stored(table(spark, sf_dir, "documents"), spec, "documents"), spec, PROVIDER, TENANT)
    return back.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "lang")


def roundtrip_conversations(spark, sf_dir):
    spec = CATALOGUE["Conversation"]
    back = codec.decrypt(stored(table(spark, sf_dir, "conversations"), spec, "conversations"), spec, PROVIDER, TENANT)
    return back.select("conv_id", "turn", "role", "text")


def roundtrip_null_empty(spark, sf_dir):
    key = F.col("c_custkey") % 7
    odd = customers(spark, sf_dir).withColumn("c_name", F.when(key == 0, F.lit(None)).when(key == 1, F.lit("")).otherwise(F.col("c_name")))
    kept = stored(odd, CUSTOMER, "customers")
    return codec.decrypt(kept, CUSTOMER, PROVIDER, TENANT).select("c_custkey", "c_name", F.col("c_nameIndex").isNull().alias("index_is_null"))


def search_equals(spark, sf_dir):
    return _opened(search.where_equals(stored_rotated(spark, sf_dir), CUSTOMER, "c_name", "Customer#000000042", PROVIDER, TENANT))


def search_equals_normalized(spark, sf_dir):
    return _opened(search.where_equals(stored_rotated(spark, sf_dir), CUSTOMER, "c_name", "  Customer#000000007　", PROVIDER, TENANT))


def search_no_match(spark, sf_dir):
    return _opened(search.where_equals(stored_rotated(spark, sf_dir), CUSTOMER, "c_name", "customer#000000042", PROVIDER, TENANT))


def search_and_chain(spark, sf_dir):
    first = search.where_equals(stored_rotated(spark, sf_dir), CUSTOMER, "c_mktsegment", "BUILDING", PROVIDER, TENANT)
    return _opened(search.where_equals(first, CUSTOMER, "email", "customer#000000042@example.com", PROVIDER, TENANT))


def search_segment(spark, sf_dir):
    return _opened(search.where_equals(stored_rotated(spark, sf_dir), CUSTOMER, "c_mktsegment", "BUILDING", PROVIDER, TENANT))


_TERMS = ["Customer#000000003", "Customer#000000004", "Customer#000000005", "Customer#000000004", " Customer#000000003 "]


def search_in(spark, sf_dir):
    return _opened(search.where_in(stored_rotated(spark, sf_dir), CUSTOMER, "c_name", _TERMS[:3], PROVIDER, TENANT))


def search_in_dups(spark, sf_dir):
    return _opened(search.where_in(stored_rotated(spark, sf_dir), CUSTOMER, "c_name", _TERMS, PROVIDER, TENANT))


def search_in_hidden(spark, sf_dir):
    return _opened(search.where_in(stored_rotated(spark, sf_dir), CUSTOMER, "c_name", _TERMS, PROVIDER, TENANT, hide_terms=True))


def search_in_empty(spark, sf_dir):
    return _opened(search.where_in(stored_rotated(spark, sf_dir), CUSTOMER, "c_name", [], PROVIDER, TENANT))


def search_email(spark, sf_dir):
    return _opened(search.where_email(stored_rotated(spark, sf_dir), CUSTOMER, "email", " CUSTOMER#000000011@Example.com ", PROVIDER, TENANT))


def search_null_value(spark, sf_dir):
    odd = customers(spark, sf_dir).withColumn("email", F.when(F.col("c_custkey") % 5 != 0, F.col("email")))
    return stored(odd, CUSTOMER, "customers").where(F.col("email").isNull()).select("c_custkey")


def search_rotated(spark, sf_dir):
    terms = [f"Customer#{k:09d}" for k in range(1, 31)]
    return _opened(search.where_in(stored_rotated(spark, sf_dir), CUSTOMER, "c_name", terms, PROVIDER, TENANT))


def search_current_only(spark, sf_dir):
    terms = [f"Customer#{k:09d}" for k in range(1, 31)]
    return _opened(search.where_in(stored_rotated(spark, sf_dir), CUSTOMER, "c_name", terms, NEWEST_ONLY, TENANT))


def blind_index_hex(spark, sf_dir):
    return stored(customers(spark, sf_dir), CUSTOMER, "customers").select("c_custkey", F.lower(F.hex("c_nameIndex")).alias("name_index"), F.lower(F.hex("emailIndex")).alias("email_index"))


def envelope_header(spark, sf_dir):
    p = F.col("p")
    parsed = stored_rotated(spark, sf_dir).select("c_custkey", F.octet_length(from_text(F.col("c_name"))).cast("long").alias("bytes"), parse(from_text(F.col("c_name"))).alias("p"))
    return parsed.select("c_custkey", "bytes", p["code"].alias("code"), p["version"].alias("version"), p["suite"].alias("suite"), p["scheme"].alias("scheme"), F.lower(F.hex(p["key_id"])).alias("key_id"), F.octet_length(p["ciphertext"]).cast("long").alias("cipher_bytes"))


def error_blobs() -> list[tuple[str, bytes, int]]:
    """(name, bytes, expected code), made from a valid envelope by one change each."""
    base = bytes.fromhex("50454e4301010112") + bytes(range(1, 19)) + b"\x0c" + bytes(range(12)) + b"\x10" + bytes(range(100, 116)) + (3).to_bytes(4, "big") + bytes.fromhex("aabbcc")

    def put(at: int, value: int) -> bytes:
        return base[:at] + bytes([value]) + base[at + 1 :]

    return [
        ("valid", base, 0),
        ("three zero bytes", bytes(3), 1),
        ("magic only", base[:4], 1),
        ("zero bytes", bytes(24), 2),
        ("version", put(4, 2), 3),
        ("suite zero", put(5, 0), 4),
        ("suite unknown", put(5, 0x7F), 4),
        ("suite reserved", put(5, 2), 5),
        ("scheme unknown", put(6, 0x7F), 6),
        ("scheme reserved", put(6, 2), 7),
        ("key id length zero", put(7, 0), 8),
        ("key id too long", put(7, 0xFF), 9),
        ("cut after key id", base[:26], 1),
        ("nonce length", put(26, 11), 10),
        ("cut in nonce", base[:27], 11),
        ("cut after nonce", base[:39], 1),
        ("tag length", put(39, 15), 12),
        ("cut in tag", base[:40], 13),
        ("cut after tag", base[:56], 1),
        ("length too large", base[:56] + (99).to_bytes(4, "big") + base[60:], 14),
        ("more data", base + b"\x01\x02\x03", 15),
        ("largest length", base[:56] + b"\xff\xff\xff\xff" + base[60:], 14),
        ("short key id", bytes.fromhex("50454e4301010104aabbccdd0c000102030405060708090a0b10f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff00000003112233"), 0),
    ]


def envelope_errors(spark, sf_dir):
    blobs = spark.createDataFrame([(n, bytearray(b)) for n, b, _ in error_blobs()], "name string, b binary")
    return blobs.select("name", parse(F.col("b"))["code"].alias("code"))


_DETECTED = [("plain text", "hello"), ("base64 text", "aGVsbG8gd29ybGQ="), ("magic as text", "PENC"), ("magic in base64", "UEVOQw=="), ("empty", ""), ("no base64", "UEVOQ!!")]


def detect_envelope(spark, sf_dir):
    import base64

    valid = base64.b64encode(error_blobs()[0][1]).decode()
    rows = spark.createDataFrame([*_DETECTED, ("envelope", valid), ("cut envelope", valid[:-8])], "name string, v string")
    return rows.select("name", is_envelope(F.col("v"), True).alias("is_envelope"))


def _version(key_id):
    return F.conv(F.hex(F.substring(key_id, -2, 2)), 16, 10).cast("long")


def stored_key_version(spark, sf_dir):
    f = CUSTOMER.field("c_name")
    return stored_rotated(spark, sf_dir).select("c_custkey", _version(migrate.stored_key_id(F.col("c_name"), f)).alias("version"))


def needs_reencryption(spark, sf_dir):
    f = CUSTOMER.field("c_name")
    old = migrate.needs_reencryption(F.col("c_name"), f, PROVIDER.current_key_id(TENANT))
    return stored_rotated(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum(old.cast("long")).alias("needing"))


def migration_plan(spark, sf_dir):
    planned = migrate.migration_plan(stored_rotated(spark, sf_dir), CUSTOMER, PROVIDER, TENANT)
    return planned.select("c_custkey", F.explode("plan").alias("p")).select("c_custkey", F.col("p.field").alias("field"), _version(F.col("p.stored_key_id")).alias("stored_version"), _version(F.col("p.current_key_id")).alias("current_version"))


def reencrypt_search(spark, sf_dir):
    renewed = written(migrate.reencrypt(stored_rotated(spark, sf_dir), CUSTOMER, PROVIDER, TENANT), "renewed")
    terms = [f"Customer#{k:09d}" for k in range(1, 31)]
    return codec.decrypt(search.where_in(renewed, CUSTOMER, "c_name", terms, NEWEST_ONLY, TENANT), CUSTOMER, NEWEST_ONLY, TENANT).select("c_custkey", "c_name")


def reencrypt_whole_table(spark, sf_dir):
    return _batched(spark, stored_rotated(spark, sf_dir), migrate.BatchOptions())[1]


def _batched(spark, before, options):
    """What the batches wrote, and a row for each batch, counted from the written rows: migrated ones have other bytes and the current key."""
    results = migrate.planned(before, CUSTOMER, PROVIDER, TENANT, "c_custkey", options)
    renewed = written(migrate.resumed(before, CUSTOMER, PROVIDER, TENANT, "c_custkey", [None, *(r.next for r in results if r.has_more)]), "batches")
    old = before.select("c_custkey", F.col("c_name").alias("before"))
    current = ~migrate.needs_reencryption(F.col("c_name"), CUSTOMER.field("c_name"), PROVIDER.current_key_id(TENANT))
    same = F.col("c_name") == F.col("before")
    counts = renewed.join(old, "c_custkey").groupBy("batch").agg(F.count_if(~same & current).alias("migrated"), F.count_if(same & current).alias("skipped"))
    done, progress = [], migrate.Progress()
    for r in counts.orderBy("batch").collect():
        progress = progress.after(migrate.BatchResult(migrated=r.migrated, skipped=r.skipped, next=results[r.batch - 1].next))
        done.append((progress.batches, r.migrated, r.skipped, progress.processed, progress.is_complete))
    return renewed.drop("batch"), spark.createDataFrame(done, "batch long, migrated long, skipped long, total long, complete boolean")


def upsert_keeps_bytes(spark, sf_dir):
    before = stored(customers(spark, sf_dir), CUSTOMER, "before")
    changed = (F.col("c_custkey") <= 20) & (F.col("c_custkey") % 2 == 0)  # the rows that the SQL has; every customer is among the changes
    changes = customers(spark, sf_dir).withColumn("email", F.when(changed, F.lit("new@example.com")).otherwise(F.col("email")))
    after = written(write.upsert(before, changes, CUSTOMER, PROVIDER, TENANT, "c_custkey"), "after")
    both = after.select("c_custkey", "c_name", "email").join(before.select("c_custkey", F.col("c_name").alias("n"), F.col("email").alias("e")), "c_custkey")
    return both.select("c_custkey", (F.col("c_name") == F.col("n")).alias("name_kept"), (F.col("email") == F.col("e")).alias("email_kept"))


def audit_report(spark, sf_dir):
    return audit(CATALOGUE).frame(spark).select(F.concat_ws(".", "entity", "column").alias("path"), "classification")


def audit_unclassified(spark, sf_dir):
    return audit_report(spark, sf_dir).where("classification = 'UNCLASSIFIED'")


def _marked(spark):
    return spark.createDataFrame([], CUSTOMER.stored_schema())


def lint_projection(spark, sf_dir):
    return lint_frame(spark, _marked(spark).select("c_custkey", "email"))


def lint_equality(spark, sf_dir):
    return lint_frame(spark, _marked(spark).where(F.col("c_name") == "x"))


def leak_check(spark, sf_dir):
    plain = customers(spark, sf_dir)
    return write.leaks(stored(plain, CUSTOMER, "customers"), plain, CUSTOMER, "c_custkey")


def search_with_children(spark, sf_dir):
    orders = CATALOGUE["Order"]
    children = stored(table(spark, sf_dir, "orders"), orders, "orders")
    found = search.where_in(stored_rotated(spark, sf_dir), CUSTOMER, "c_name", _TERMS, PROVIDER, TENANT).select("c_custkey", "c_name")
    joined = found.join(children, F.col("c_custkey") == F.col("o_custkey"), "left").select(*found.columns, *children.columns)
    opened = codec.decrypt(joined, orders, PROVIDER, TENANT)
    names = codec.decrypt(opened.withColumns({c.name: F.lit(None).cast(c.dataType) for c in CUSTOMER.schema.fields if c.name not in opened.columns}), CUSTOMER, PROVIDER, TENANT, fields=["c_name"])
    return names.select("c_custkey", "c_name", "o_orderkey", "o_orderpriority")


def match_then_order(spark, sf_dir):
    return search_segment(spark, sf_dir).orderBy("c_custkey")


def segment_totals(spark, sf_dir):
    """Aggregation over decrypted data, by a plaintext-only join key."""
    opened = codec.decrypt(stored(customers(spark, sf_dir), CUSTOMER, "customers"), CUSTOMER, PROVIDER, TENANT, fields=["c_mktsegment"])
    return opened.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def stream_roundtrip(spark, sf_dir):
    """Extension: the customer table as a stream, encrypted to Parquet, read and decrypted."""
    from veilframe.sources.store import scratch
    from veilframe.streaming import stream_to_parquet

    source = scratch(spark, "stream-in")
    customers(spark, sf_dir).write.parquet(source)
    stream = spark.readStream.schema(CUSTOMER.schema).parquet(source)
    path = scratch(spark, "stream")
    stream_to_parquet(stream, CUSTOMER, PROVIDER, TENANT, path, scratch(spark, "stream-log")).trigger(availableNow=True).start().awaitTermination()
    return _opened(spark.read.parquet(path))


QUERIES = [
    roundtrip_string, roundtrip_binary, roundtrip_documents, roundtrip_conversations, roundtrip_null_empty, search_equals, search_equals_normalized, search_no_match, search_and_chain, search_segment,
    search_in, search_in_dups, search_in_hidden, search_in_empty, search_email, search_null_value, search_rotated, search_current_only, blind_index_hex, envelope_header, envelope_errors, detect_envelope,
    stored_key_version, needs_reencryption, migration_plan, reencrypt_search, reencrypt_whole_table, upsert_keeps_bytes, audit_report, audit_unclassified, lint_projection, lint_equality, leak_check,
    search_with_children, match_then_order, segment_totals, stream_roundtrip,
]


def queries() -> dict:
    from veilframe import queries_keys

    return {q.__name__: q for q in [*QUERIES, *queries_keys.QUERIES]}


#: The blind-index keys of the customer's name and email under the current version, so that the SQL doesn't depend on the derivation that it checks.
INDEX_KEYS = {"name": "3af314f3173dc0cb4782d9de9593e592b1d08c61b659e0b15399466814d1d414", "email": "9495ab840ad09627d399e2f7151efb023af2b59c40fd6dddb44f6f5de0cabbbf"}


def _hmac_sql(value: str, logical: str) -> str:
    """HMAC-SHA256 of a value, in SQL."""
    block = bytes.fromhex(INDEX_KEYS[logical]).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({value}))))"


def _values(rows, *names: str) -> str:
    def one(v) -> str:
        return str(v).lower() if isinstance(v, bool | int) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({', '.join(names)})"


def oracle_sql() -> dict[str, str]:
    from veilframe import queries_keys

    return _sql() | queries_keys.oracle_sql()


def _sql() -> dict[str, str]:
    row = "SELECT c_custkey, c_name FROM customer WHERE "
    three = "('Customer#000000003', 'Customer#000000004', 'Customer#000000005')"
    version = "c_custkey % 3 + 1"
    ids = " ".join(f"WHEN {v} THEN '{PROVIDER.key_id(TENANT, v).hex()}'" for v in ROOTS)
    overhead = FIXED_OVERHEAD + 18 + NONCE_BYTES + TAG_BYTES
    return {
        "roundtrip_string": "SELECT c_custkey, c_name, lower(c_name) || '@example.com' AS email, c_mktsegment, c_acctbal FROM customer",
        "roundtrip_binary": "SELECT page_id, md5(html) AS html_md5, strlen(html)::BIGINT AS bytes FROM pages",
        "roundtrip_documents": "SELECT doc_id, md5(text) AS text_md5, lang FROM documents",
        "roundtrip_conversations": "SELECT conv_id, turn, role, text FROM conversations",
        "roundtrip_null_empty": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN '' ELSE c_name END AS c_name, c_custkey % 7 = 0 AS index_is_null FROM customer",
        "search_equals": row + "c_name = 'Customer#000000042'",
        "search_equals_normalized": row + "c_name = 'Customer#000000007'",
        "search_no_match": row + "c_name = 'customer#000000042'",
        "search_and_chain": row + "c_mktsegment = 'BUILDING' AND lower(c_name) = 'customer#000000042'",
        "search_segment": row + "c_mktsegment = 'BUILDING'",
        "search_in": row + f"c_name IN {three}",
        "search_in_dups": row + f"c_name IN {three}",
        "search_in_hidden": row + f"c_name IN {three}",
        "search_in_empty": row + "false",
        "search_email": row + "lower(c_name) || '@example.com' = 'customer#000000011@example.com'",
        "search_null_value": "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0",
        "search_rotated": row + "c_name BETWEEN 'Customer#000000001' AND 'Customer#000000030'",
        "search_current_only": row + "c_name BETWEEN 'Customer#000000001' AND 'Customer#000000030' AND c_custkey % 3 = 2",
        "blind_index_hex": f"SELECT c_custkey, {_hmac_sql('c_name', 'name')} AS name_index, {_hmac_sql("lower(c_name) || '@example.com'", 'email')} AS email_index FROM customer",
        "envelope_header": f"SELECT c_custkey, ({overhead} + strlen(c_name))::BIGINT AS bytes, 0 AS code, 1 AS version, 1 AS suite, 1 AS scheme, CASE {version} {ids} END AS key_id, strlen(c_name)::BIGINT AS cipher_bytes FROM customer",
        "envelope_errors": _values([(n, c) for n, _, c in error_blobs()], "name", "code"),
        "detect_envelope": _values([*((n, False) for n, _ in _DETECTED), ("envelope", True), ("cut envelope", False)], "name", "is_envelope"),
        "stored_key_version": f"SELECT c_custkey, {version} AS version FROM customer",
        "needs_reencryption": f"SELECT count(*) AS n, sum(({version} < 3)::INTEGER)::BIGINT AS needing FROM customer",
        "migration_plan": f"SELECT c_custkey, field, {version} AS stored_version, 3::BIGINT AS current_version FROM customer, (VALUES ('c_name'), ('email'), ('c_mktsegment')) t(field) WHERE {version} < 3",
        "reencrypt_search": row + "c_name BETWEEN 'Customer#000000001' AND 'Customer#000000030'",
        "reencrypt_whole_table": f"""WITH k AS (SELECT {version} AS v, (row_number() OVER (ORDER BY c_custkey) - 1) // {migrate.DEFAULT_BATCH} + 1 AS batch FROM customer)
            SELECT batch, sum((v < 3)::INTEGER)::BIGINT AS migrated, sum((v = 3)::INTEGER)::BIGINT AS skipped, sum(count(*)) OVER (ORDER BY batch)::BIGINT AS total, batch = max(batch) OVER () AS complete FROM k GROUP BY batch""",
        "upsert_keeps_bytes": "SELECT c_custkey, true AS name_kept, NOT (c_custkey <= 20 AND c_custkey % 2 = 0) AS email_kept FROM customer",
        "audit_report": _values(
            [
                ("Customer.c_name", "encrypted searchable"), ("Customer.email", "encrypted searchable"), ("Customer.c_mktsegment", "encrypted searchable"), ("Customer.note", "plaintext"),
                ("Supplier.s_name", "encrypted"), ("Order.o_orderstatus", "UNCLASSIFIED"), ("Order.o_orderpriority", "encrypted"), ("Page.url", "plaintext"), ("Page.html", "encrypted"),
                ("Document.text", "encrypted"), ("Document.lang", "plaintext"), ("Document.source", "plaintext"), ("Conversation.role", "plaintext"), ("Conversation.text", "encrypted"),
            ],
            "path", "classification",
        ),
        "audit_unclassified": _values([("Order.o_orderstatus", "UNCLASSIFIED")], "path", "classification"),
        "lint_projection": _values([("P001", "email", "the projection returns ciphertext; decrypt first")], "rule", '"column"', "message"),
        "lint_equality": _values([("P002", "c_name", "equality on an encrypted column never holds; search by the blind index")], "rule", '"column"', "message"),
        "leak_check": _values([("c_name", False), ("email", False), ("c_mktsegment", False), ("note", False)][:3], "field", "leaks"),
        "search_with_children": f"SELECT c_custkey, c_name, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_name IN {three}",
        "match_then_order": row + "c_mktsegment = 'BUILDING' ORDER BY c_custkey",
        "segment_totals": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment",
        "stream_roundtrip": "SELECT c_custkey, c_name FROM customer",
    }
