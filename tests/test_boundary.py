"""Ranges of an index, upserts of touched rows, registered services, suites, kept keys."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from veilframe import queries, queries_keys
from veilframe.errors import SpecError
from veilframe.functions.envelope import SUITES, Suite, suite_of
from veilframe.operators import codec, write
from veilframe.queries import CUSTOMER, PROVIDER, TENANT
from veilframe.sources.keys import MasterKeyVersion, RegistryKeyProvider, ServiceKey, ServiceKind, TenantRecord, TenantRegistry, logical_name, tenant_name
from veilframe.sources.kms import KeyServices


def test_ranges_of_an_index(spark, small, tmp_path):
    plain = queries.customers(spark, small).withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 1, F.lit("hot")).otherwise(F.col("c_name")))
    write.save(plain, CUSTOMER, PROVIDER, TENANT, str(tmp_path / "a"), sort_by_index=True)
    kept = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(codec.decrypt(kept, CUSTOMER, PROVIDER, TENANT).select(*plain.columns).collect(), key=lambda r: r.c_custkey) == sorted(plain.collect(), key=lambda r: r.c_custkey)
    files = kept.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.min("c_nameIndex").alias("a"), F.max("c_nameIndex").alias("b")).collect()
    spans = sorted((r.a, r.b) for r in files if r.a is not None)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert max(r.n for r in files) < 2 * sum(r.n for r in files) / len(files)


def test_a_save_encrypts_once(spark, small):
    plain = queries.customers(spark, small)
    stored = codec.encrypt(plain, CUSTOMER, PROVIDER, TENANT)
    plan = write.ranged(stored, write._index_only(plain, CUSTOMER, PROVIDER, TENANT), "c_nameIndex")._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "RepartitionByRange" not in plan
    counted = write._index_only(plain, CUSTOMER, PROVIDER, TENANT)._jdf.queryExecution().optimizedPlan().toString()
    assert "aes_encrypt" not in counted and "aesEncrypt" not in counted


def test_an_upsert_decrypts_named_rows_only(spark, small):
    before = queries.stored(queries.customers(spark, small), CUSTOMER, "before")
    changes = queries.customers(spark, small).where("c_custkey < 5")
    after = write.upsert(before, changes, CUSTOMER, PROVIDER, TENANT, "c_custkey")
    plan = after._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    branches = [i for i, line in enumerate(plan) if depth(line) == depth(plan[1])]
    anti = "\n".join(plan[branches[0] : branches[1]])
    assert "LeftAnti" in anti and "aes" not in anti.lower()
    assert "LeftSemi" in "\n".join(plan[branches[1] :])
    with pytest.raises(ValueError, match="more than once"):
        write.upsert(before, changes.union(changes), CUSTOMER, PROVIDER, TENANT, "c_custkey")


def test_registered_services():
    made = []
    services = KeyServices().aws("alias/a", lambda: made.append(1) or queries_keys._Xor())
    assert not made and list(services) == [ServiceKind.AWS_KMS] and services.get(ServiceKind.GOOGLE_KMS) is None
    first = services[ServiceKind.AWS_KMS]
    assert services.aws("alias/b", queries_keys._Xor)[ServiceKind.AWS_KMS] is first and str(first.reference) and made == [1]
    for bad in (None, "", "  "):
        with pytest.raises(SpecError):
            services.azure(bad, queries_keys._Xor)
    with pytest.raises(ValueError):
        services.azure("http://v/keys/n", queries_keys._Xor)
    with pytest.raises(TypeError):
        services.google("projects/p/locations/l/keyRings/r/cryptoKeys/k", None)
    own = queries_keys._Xor()
    assert services.custom(own)[ServiceKind.CUSTOM] is own


def test_kept_masters_are_by_tenant_and_forgotten():
    class Counting:
        calls = 0

        def unwrap(self, wrapped):
            self.calls += 1
            return wrapped.ciphertext * 32

    service = Counting()
    versions = lambda b: (MasterKeyVersion(1, ServiceKey(ServiceKind.CUSTOM, "k"), b),)
    one = uuid.UUID(int=7)
    provider = RegistryKeyProvider(TenantRegistry([TenantRecord("a", one, versions(b"x"), 1), TenantRecord("b", one, versions(b"y"), 1)]), {ServiceKind.CUSTOM: service})
    keys = [provider.field_key(t, provider.current_key_id(t), "enc", "e", "f") for t in ("a", "b", "a")]
    assert keys[0] == keys[2] != keys[1] and service.calls == 2
    provider.forget("a")
    assert provider.field_key("b", provider.current_key_id("b"), "enc", "e", "f") == keys[1] and service.calls == 2
    assert provider.field_key("a", provider.current_key_id("a"), "enc", "e", "f") == keys[0] and service.calls == 3
    provider.forget()
    provider.field_key("b", provider.current_key_id("b"), "enc", "e", "f")
    assert service.calls == 4


def test_suites():
    assert suite_of(1).usable and (suite_of(1).nonce_bytes, suite_of(1).tag_bytes) == (12, 16) and SUITES.get(9) is None
    for bad in (lambda: suite_of(9), lambda: Suite(0, "x"), lambda: Suite(4, " "), lambda: Suite(4, "x", True), lambda: Suite(4, "x", False, 12, 16), lambda: Suite(4, "x", True, 12, -1)):
        with pytest.raises(ValueError):
            bad()


def test_names_keep_separators_that_are_no_white_space():
    assert tenant_name("　a\x1f ") == "a\x1f" and tenant_name("\x1fa") == "\x1fa"
    with pytest.raises(ValueError):
        logical_name("\x1ca")
    for blank in ("", " 　", " \n"):
        with pytest.raises(ValueError):
            tenant_name(blank)
