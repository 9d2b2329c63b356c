"""Queries of the write boundary, keys, services, failures and Unicode values, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.engine import Engine, Options
from veilframe.errors import spark_errors
from veilframe.functions.envelope import SUITES, from_text, parse
from veilframe.functions.kdf import crc32c, hkdf
from veilframe.operators import codec, migrate, search, write
from veilframe.plans.spec import Catalogue
from veilframe.queries import CATALOGUE, CUSTOMER, NEWEST_ONLY, PROVIDER, ROOTS, TENANT, _hmac_sql, _values, customers, stored, stored_rotated
from veilframe.sources.keys import LocalKeyProvider, MasterKeyVersion, RegistryKeyProvider, ServiceKey, ServiceKind, TenantRecord, TenantRegistry
from veilframe.sources.kms import ChecksummedResult, KeyServices
from veilframe.sources.store import scratch, table, written


@cache
def classified() -> Catalogue:
    """The customer alone, with all its columns classified."""
    c = Catalogue()
    customer = c.entity("Customer", CUSTOMER.schema).encrypted_entity("customer")
    customer.field("c_name").searchable("name").field("email").email("email").field("c_mktsegment").searchable("segment").field("note").plaintext()
    return c.finish()


def strict_engine(spark: SparkSession, catalogue: Catalogue) -> Engine:
    return Engine(spark, catalogue, Options().use_keys(PROVIDER).use_tenant(TENANT).strict_mode())


def save_strict(spark, sf_dir):
    """The guarded write with strict mode and ranges of the index, read back."""
    engine, path = strict_engine(spark, classified()), scratch(spark, "saved")
    engine.save(customers(spark, sf_dir), "Customer", path, sort_by_index=True)
    return engine.decrypt(spark.read.parquet(path), "Customer").select("c_custkey", "c_name", "email", "c_mktsegment", "note")


def save_then_search(spark, sf_dir):
    engine, path = strict_engine(spark, classified()), scratch(spark, "saved")
    engine.save(customers(spark, sf_dir), "Customer", path, sort_by_index=True)
    found = engine.where_email(spark.read.parquet(path), "Customer", "email", " Customer#000000017@EXAMPLE.com")
    return engine.decrypt(found, "Customer").select("c_custkey", "c_name")


def _outcome(act) -> str:
    """The name of the error that act raises, or none."""
    try:
        with spark_errors():
            act()
    except Exception as e:
        return type(e).__name__
    return "none"


def _all(df: DataFrame):
    """Computes every column of every row."""
    return lambda: df.write.format("noop").mode("overwrite").save()


def _outcomes(spark: SparkSession, cases: dict) -> DataFrame:
    return spark.createDataFrame([(name, _outcome(act)) for name, act in cases.items()], "name string, error string")


def save_refusals(spark, sf_dir):
    """What the guarded write refuses, and the plain write that goes around it."""
    plain, engine = customers(spark, sf_dir), strict_engine(spark, classified())
    kept = stored(plain, CUSTOMER, "customers")
    at = lambda name: scratch(spark, name)
    return _outcomes(
        spark,
        {
            "unclassified columns": lambda: strict_engine(spark, CATALOGUE).save(plain, "Customer", at("a")),
            "encrypted twice": lambda: engine.save(kept.select(*plain.columns), "Customer", at("b")),
            "a column is missing": lambda: engine.save(plain.drop("email"), "Customer", at("c")),
            "a column of another type": lambda: engine.save(plain.withColumn("email", F.lit(1)), "Customer", at("d")),
            "repeated keys in changes": lambda: engine.upsert(kept, plain.union(plain), "Customer", "c_custkey"),
            "plain write": lambda: plain.write.parquet(at("e")),
            "guarded write": lambda: engine.save(plain, "Customer", at("f")),
        },
    )


def decrypt_failures(spark, sf_dir):
    """What reading a whole table raises if one of its values is wrong."""
    kept = stored_rotated(spark, sf_dir)
    one = F.col("c_custkey") == 1
    opened = lambda df, provider=PROVIDER, tenant=TENANT: _all(codec.decrypt(df, CUSTOMER, provider, tenant))
    raw = from_text(F.col("c_name"))
    put = lambda value: kept.withColumn("c_name", F.when(one, value).otherwise(F.col("c_name")))
    last = F.conv(F.substring(F.hex(raw), -2, 2), 16, 10).cast("int")
    flipped = F.base64(F.unhex(F.concat(F.expr("left(hex(unbase64(c_name)), length(hex(unbase64(c_name))) - 2)"), F.lpad(F.hex((255 - last).cast("long")), 2, "0"))))
    return _outcomes(
        spark,
        {
            "intact": opened(kept),
            "another tenant": opened(kept, tenant="globex"),
            "an unknown version": opened(kept, provider=NEWEST_ONLY),
            "another root": opened(kept, provider=LocalKeyProvider({v: b"\x44" * 32 for v in ROOTS}, 3)),
            "a changed byte": opened(put(flipped)),
            "a moved value": opened(put(F.col("email"))),
            "no Base64": opened(put(F.lit("plain text!"))),
            "no envelope": opened(put(F.lit("cGxhaW4="))),
            "a null": opened(put(F.lit(None).cast("string"))),
        },
    )


def request_failures(spark, sf_dir):
    """What fails when a query is built, before any job."""
    kept = stored(customers(spark, sf_dir), CUSTOMER, "customers")
    supplier = CATALOGUE["Supplier"]
    return _outcomes(
        spark,
        {
            "a null term": lambda: search.where_equals(kept, CUSTOMER, "c_name", None, PROVIDER, TENANT),
            "a null among terms": lambda: search.where_in(kept, CUSTOMER, "c_name", ["x", None], PROVIDER, TENANT),
            "not searchable": lambda: search.where_equals(kept, supplier, "s_name", "x", PROVIDER, TENANT),
            "not encrypted": lambda: search.where_equals(kept, CUSTOMER, "note", "x", PROVIDER, TENANT),
            "an expression": lambda: search.where_equals(kept, CUSTOMER, F.col("c_name"), "x", PROVIDER, TENANT),
            "an unknown entity": lambda: CATALOGUE["Nobody"],
            "no tenant": lambda: Engine(spark, CATALOGUE, Options().use_keys(PROVIDER).use_tenant(lambda: None)).decrypt(kept, "Customer"),
            "keys twice": lambda: Options().use_keys(PROVIDER).use_keys(PROVIDER),
            "no keys": lambda: Engine(spark, CATALOGUE, Options().use_tenant(TENANT)),
            "a service without a key": lambda: KeyServices().aws(" ", _Xor),
            "a bad reference": lambda: KeyServices().google("projects/p", _Xor),
        },
    )


class _Xor:
    """Stands for a service's client; no encryption at all."""

    def encrypt(self, key, data):
        return bytes(b ^ 0x5A for b in data)

    decrypt = encrypt

    def wrap_key(self, algorithm, data):
        return self.encrypt(algorithm, data)

    unwrap_key = wrap_key


class _XorChecked:
    def encrypt(self, key, data, checksum):
        made = bytes(b ^ 0x5A for b in data)
        return ChecksummedResult(made, crc32c(made), checksum == crc32c(data))

    decrypt = encrypt


SERVICES = {
    ServiceKind.AWS_KMS: "alias/customers",
    ServiceKind.AZURE_KEY_VAULT: "https://vault.example/keys/customers",
    ServiceKind.GOOGLE_KMS: "projects/p/locations/l/keyRings/r/cryptoKeys/customers",
}


def registry(kind: ServiceKind, versions: int) -> RegistryKeyProvider:
    """A provider over one tenant's record, whose versions a service has wrapped."""
    services = KeyServices().aws(SERVICES[ServiceKind.AWS_KMS], _Xor).azure(SERVICES[ServiceKind.AZURE_KEY_VAULT], _Xor).google(SERVICES[ServiceKind.GOOGLE_KMS], _XorChecked)
    key, master_id = ServiceKey(kind, SERVICES[kind]), uuid.UUID("00112233-4455-6677-8899-aabbccddeeff")
    wrapped = [MasterKeyVersion(v, key, services[kind].wrap(bytes([v]), bytes([v]) * 32).ciphertext) for v in range(1, versions + 1)]
    return RegistryKeyProvider(TenantRegistry([TenantRecord(TENANT, master_id, tuple(wrapped), versions)]), services)


def service_roundtrip(spark, sf_dir):
    """Customers under keys that each of the three services has wrapped."""
    parts = []
    for kind in SERVICES:
        provider = registry(kind, 1)
        kept = written(codec.encrypt(customers(spark, sf_dir), CUSTOMER, provider, TENANT), "customers")
        provider.forget(TENANT)
        parts.append(codec.decrypt(kept, CUSTOMER, provider, TENANT).select(F.lit(kind.name).alias("service"), "c_custkey", "c_name"))
    return parts[0].union(parts[1]).union(parts[2])


def registry_search(spark, sf_dir):
    """A search under both versions of a registry's record, after its rotation."""
    old, new = registry(ServiceKind.AWS_KMS, 1), registry(ServiceKind.AWS_KMS, 2)
    even = F.col("c_custkey") % 2 == 0
    plain = customers(spark, sf_dir)
    kept = written(codec.encrypt(plain.where(even), CUSTOMER, old, TENANT).union(codec.encrypt(plain.where(~even), CUSTOMER, new, TENANT)), "customers")
    found = search.where_in(kept, CUSTOMER, "c_name", [f"Customer#{k:09d}" for k in range(1, 21)], new, TENANT)
    found = found.withColumn("old", migrate.needs_reencryption(F.col("c_name"), CUSTOMER.field("c_name"), new.current_key_id(TENANT)))
    return codec.decrypt(found, CUSTOMER, new, TENANT).select("c_custkey", "c_name", "old")


def registry_key_ids(spark, sf_dir):
    """The stored key ids: the record's id with its first three groups turned, and the version."""
    kept = written(codec.encrypt(customers(spark, sf_dir), CUSTOMER, registry(ServiceKind.GOOGLE_KMS, 2), TENANT), "customers")
    return kept.select("c_custkey", F.lower(F.hex(migrate.stored_key_id(F.col("c_name"), CUSTOMER.field("c_name")))).alias("key_id"))


def tenants_apart(spark, sf_dir):
    """Each tenant finds its own rows only, for one term in one table."""
    plain = customers(spark, sf_dir)
    odd = F.col("c_custkey") % 2 == 1
    kept = written(codec.encrypt(plain.where(odd), CUSTOMER, PROVIDER, "acme").union(codec.encrypt(plain.where(~odd), CUSTOMER, PROVIDER, " globex ")), "customers")
    found = lambda t: search.where_equals(kept, CUSTOMER, "c_mktsegment", "BUILDING", PROVIDER, t)
    parts = [codec.decrypt(found(t), CUSTOMER, PROVIDER, t).select(F.lit(t).alias("tenant"), "c_custkey", "c_mktsegment") for t in ("acme", "globex")]
    return parts[0].union(parts[1])


#: Decomposed letters, marks that trim, and a capital that lowers to another letter.
_WIDE_NAME = (" É ", "　")


def wide_customers(spark, sf_dir):
    """Customers whose names and emails are changed by trimming, composing and lower case."""
    return customers(spark, sf_dir).withColumns({"c_name": F.concat(F.lit(_WIDE_NAME[0]), F.col("c_name"), F.lit(_WIDE_NAME[1])), "email": F.concat(F.lit(" ÀÅ."), F.col("email"), F.lit(" "))})


def search_unicode(spark, sf_dir):
    """Terms in composed form find values stored in decomposed form, which come back as they were."""
    kept = stored(wide_customers(spark, sf_dir), CUSTOMER, "customers")
    found = search.where_in(kept, CUSTOMER, "c_name", [f"É Customer#{k:09d}" for k in range(1, 11)], PROVIDER, TENANT)
    return codec.decrypt(found, CUSTOMER, PROVIDER, TENANT).select("c_custkey", "c_name")


def search_unicode_email(spark, sf_dir):
    kept = stored(wide_customers(spark, sf_dir), CUSTOMER, "customers")
    found = search.where_email(kept, CUSTOMER, "email", "àÅ.customer#000000009@example.com", PROVIDER, TENANT)
    return codec.decrypt(found, CUSTOMER, PROVIDER, TENANT).select("c_custkey", "email")


def blind_index_unicode(spark, sf_dir):
    kept = stored(wide_customers(spark, sf_dir), CUSTOMER, "customers")
    return kept.select("c_custkey", F.lower(F.hex("c_nameIndex")).alias("name_index"), F.lower(F.hex("emailIndex")).alias("email_index"))


def resume_batches(spark, sf_dir):
    """Batches that each begin anew from the text of the token before, all at once; their keys are those of the rows written."""
    before = stored_rotated(spark, sf_dir)
    results = migrate.planned(before, CUSTOMER, PROVIDER, TENANT, "c_custkey")
    tokens = [None, *(migrate.ResumeToken(str(r.next)) for r in results if r.has_more)]
    renewed = written(migrate.resumed(before, CUSTOMER, PROVIDER, TENANT, "c_custkey", tokens), "batches")
    keys = {r.batch: (r.first_key, r.last_key) for r in renewed.groupBy("batch").agg(F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key")).collect()}
    done = [(n, *keys[n], r.migrated, r.skipped, r.has_more) for n, r in enumerate(results, 1)]
    return spark.createDataFrame(done, "batch long, first_key long, last_key long, migrated long, skipped long, has_more boolean")


def search_exists(spark, sf_dir):
    """Whether there is a row for a term."""
    kept = stored_rotated(spark, sf_dir)
    terms = ["Customer#000000001", "Customer#000000002 ", "nobody"]
    rows = [(t, not search.where_equals(kept, CUSTOMER, "c_name", t, PROVIDER, TENANT).isEmpty()) for t in terms]
    return spark.createDataFrame(rows, "term string, found boolean")


def sorted_children(spark, sf_dir):
    """Every customer's decrypted priorities as a sorted list."""
    orders = CATALOGUE["Order"]
    opened = codec.decrypt(stored(table(spark, sf_dir, "orders"), orders, "orders"), orders, PROVIDER, TENANT)
    return opened.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), ", ").alias("priorities"))


def stored_form(spark, sf_dir):
    """Equal plaintexts have different ciphertexts and nonces, and equality with a plaintext never holds."""
    kept = stored(customers(spark, sf_dir), CUSTOMER, "customers")
    nonces = F.explode(F.array(*[parse(from_text(F.col(f.name)))["nonce"] for f in CUSTOMER.fields]))
    counts = kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("ciphertexts"), F.count_distinct("c_mktsegmentIndex").alias("indexes"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("equal"))
    return counts.crossJoin(kept.select(nonces.alias("nonce")).agg(F.count_distinct("nonce").alias("nonces")))  # one row each


def suites(spark, sf_dir):
    return spark.createDataFrame([(s.number, s.name, s.usable, s.nonce_bytes, s.tag_bytes) for s in SUITES.values()], "number int, name string, usable boolean, nonce_bytes int, tag_bytes int")


def published_vectors(spark, sf_dir):
    """Published test vectors of HKDF-SHA256 (RFC 5869, cases 1 and 3) and CRC-32C."""
    made = [
        ("hkdf 1", hkdf(b"\x0b" * 22, bytes(range(0xF0, 0xFA)), 42, bytes(range(13))).hex()),
        ("hkdf 3", hkdf(b"\x0b" * 22, b"", 42).hex()),
        ("crc32c", f"{crc32c(b'123456789'):08x}"),
    ]
    return spark.createDataFrame(made, "name string, value string")


def upsert_new_and_changed(spark, sf_dir):
    """Changes to some customers and new ones, given by every tenth customer."""
    before = stored_rotated(spark, sf_dir)
    plain = customers(spark, sf_dir).where("c_custkey % 10 = 0")
    changes = plain.withColumn("note", F.lit("changed")).union(plain.withColumn("c_custkey", -1 - F.col("c_custkey")).withColumn("email", F.lit(None).cast("string")))
    after = written(write.upsert(before, changes, CUSTOMER, PROVIDER, TENANT, "c_custkey"), "after")
    return codec.decrypt(after, CUSTOMER, PROVIDER, TENANT).select("c_custkey", "c_name", "email", "note")


QUERIES = [
    save_strict, save_then_search, save_refusals, decrypt_failures, request_failures, service_roundtrip, registry_search, registry_key_ids, tenants_apart, search_unicode, search_unicode_email,
    blind_index_unicode, resume_batches, search_exists, sorted_children, stored_form, suites, published_vectors, upsert_new_and_changed,
]


def oracle_sql() -> dict[str, str]:
    row = "SELECT c_custkey, c_name FROM customer WHERE "
    wide = "chr(160) || 'E' || chr(769) || ' ' || c_name || chr(12288)"
    email = "lower(c_name) || '@example.com'"
    wide_email = f"chr(8195) || chr(192) || 'A' || chr(778) || '.' || {email} || chr(8232)"
    version = "c_custkey % 3 + 1"
    return {
        "save_strict": f"SELECT c_custkey, c_name, {email} AS email, c_mktsegment, 'customer' AS note FROM customer",
        "save_then_search": row + "c_name = 'Customer#000000017'",
        "save_refusals": _values(
            [("unclassified columns", "StrictModeError"), ("encrypted twice", "AlreadyEncryptedError"), ("a column is missing", "SpecError"), ("a column of another type", "SpecError"), ("repeated keys in changes", "ValueError"), ("plain write", "none"), ("guarded write", "none")],
            "name", "error",
        ),
        "decrypt_failures": _values(
            [
                ("intact", "none"), ("another tenant", "KeyResolutionError"), ("an unknown version", "KeyResolutionError"), ("another root", "KeyResolutionError"), ("a changed byte", "DecryptionError"),
                ("a moved value", "DecryptionError"), ("no Base64", "EnvelopeError"), ("no envelope", "EnvelopeError"), ("a null", "none"),
            ],
            "name", "error",
        ),
        "request_failures": _values(
            [
                ("a null term", "ValueError"), ("a null among terms", "ValueError"), ("not searchable", "SpecError"), ("not encrypted", "SpecError"), ("an expression", "SpecError"), ("an unknown entity", "NotRegisteredError"),
                ("no tenant", "ValueError"), ("keys twice", "ConfiguredTwiceError"), ("no keys", "FieldEncryptionError"), ("a service without a key", "SpecError"), ("a bad reference", "ValueError"),
            ],
            "name", "error",
        ),
        "service_roundtrip": "SELECT service, c_custkey, c_name FROM customer, (VALUES ('AWS_KMS'), ('AZURE_KEY_VAULT'), ('GOOGLE_KMS')) t(service)",
        "registry_search": "SELECT c_custkey, c_name, c_custkey % 2 = 0 AS old FROM customer WHERE c_name BETWEEN 'Customer#000000001' AND 'Customer#000000020'",
        "registry_key_ids": "SELECT c_custkey, '33221100554477668899aabbccddeeff0002' AS key_id FROM customer",
        "tenants_apart": "SELECT CASE WHEN c_custkey % 2 = 1 THEN 'acme' ELSE 'globex' END AS tenant, c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
        "search_unicode": f"SELECT c_custkey, {wide} AS c_name FROM customer WHERE c_name BETWEEN 'Customer#000000001' AND 'Customer#000000010'",
        "search_unicode_email": f"SELECT c_custkey, {wide_email} AS email FROM customer WHERE c_name = 'Customer#000000009'",
        "blind_index_unicode": f"SELECT c_custkey, {_hmac_sql("chr(201) || ' ' || c_name", 'name')} AS name_index, {_hmac_sql(f"chr(224) || chr(229) || '.' || {email}", 'email')} AS email_index FROM customer",
        "resume_batches": f"""WITH k AS (SELECT c_custkey, {version} AS v, (row_number() OVER (ORDER BY c_custkey) - 1) // {migrate.DEFAULT_BATCH} + 1 AS batch FROM customer)
            SELECT batch, min(c_custkey)::BIGINT AS first_key, max(c_custkey)::BIGINT AS last_key, sum((v < 3)::INTEGER)::BIGINT AS migrated, sum((v = 3)::INTEGER)::BIGINT AS skipped, batch < max(batch) OVER () AS has_more FROM k GROUP BY batch""",
        "search_exists": "SELECT term, EXISTS (SELECT 1 FROM customer WHERE c_name = trim(term)) AS found FROM (VALUES ('Customer#000000001'), ('Customer#000000002 '), ('nobody')) t(term)",
        "sorted_children": "SELECT o_custkey, string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey",
        "stored_form": "SELECT count(*) AS n, count(*) AS ciphertexts, count(DISTINCT c_mktsegment) AS indexes, 0::BIGINT AS equal, 3 * count(*) AS nonces FROM customer",
        "suites": _values([(1, "AES-256-GCM", True, 12, 16), (2, "AES-256-GCM-SIV", False, 0, 0), (3, "XChaCha20-Poly1305", False, 0, 0), (16, "AES-256-SIV", False, 0, 0)], "number", "name", "usable", "nonce_bytes", "tag_bytes"),
        "published_vectors": _values(
            [
                ("hkdf 1", "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"),
                ("hkdf 3", "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"),
                ("crc32c", "e3069283"),
            ],
            "name", "value",
        ),
        "upsert_new_and_changed": f"""SELECT c_custkey, c_name, {email} AS email, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE 'customer' END AS note FROM customer
            UNION ALL SELECT -1 - c_custkey, c_name, NULL, 'customer' FROM customer WHERE c_custkey % 10 = 0""",
    }
