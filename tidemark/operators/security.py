"""Column encryption, derived keys, per-subject keys that can be destroyed, Parquet modular encryption settings."""

from __future__ import annotations

import hmac
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hkdf


def column_keys(master: bytes, classes: dict[str, int], salt: bytes = b"") -> dict[str, bytes]:
    """A 256-bit key for each personal or sensitive column (class 2 or 3), derived from the master key and the name."""
    return {name: hkdf(master, salt, b"column:" + name.encode(), 32) for name, c in classes.items() if c in (2, 3)}


def readable(keys: dict[str, bytes], granted: list[str]) -> dict[str, bytes]:
    """The keys of the granted columns."""
    return {c: k for c, k in keys.items() if c in granted}


def encrypt_columns(df: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """AES-GCM, a column a key; the column's name is authenticated. Values become binary, nulls stay."""
    return df.withColumns({c: F.aes_encrypt(F.col(c).cast("string"), F.lit(bytearray(k)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), F.lit(c)) for c, k in keys.items()})


def decrypt_columns(df: DataFrame, keys: dict[str, bytes], kinds: dict[str, str] | None = None) -> DataFrame:
    return df.withColumns({c: F.try_aes_decrypt(F.col(c), F.lit(bytearray(k)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(c)).cast("string").cast((kinds or {}).get(c, "string")) for c, k in keys.items()})


def new_subject_keys(subjects: DataFrame, key: str = "subject") -> DataFrame:
    """A random 256-bit key for each subject. Write the table once: keys are drawn anew whenever it is computed."""

    def run(frames):
        for f in frames:
            yield f[[key]].assign(subject_key=[os.urandom(32) for _ in range(len(f))])

    kind = dict(subjects.dtypes)[key]
    return subjects.select(key).distinct().mapInPandas(run, f"`{key}` {kind}, subject_key binary")


def seal(df: DataFrame, keys: DataFrame, column: str, key: str = "subject") -> DataFrame:
    """The column under each row's subject key."""
    return df.join(keys, key).withColumn(column, F.aes_encrypt(F.col(column).cast("string"), F.col("subject_key"), F.lit("GCM"))).drop("subject_key")


def unseal(df: DataFrame, keys: DataFrame, column: str, key: str = "subject") -> DataFrame:
    """The column in clear where the subject's key still exists, else null."""
    return df.join(keys, key, "left").withColumn(column, F.try_aes_decrypt(F.col(column), F.col("subject_key"), F.lit("GCM")).cast("string")).drop("subject_key")


def shred(keys: DataFrame, subjects: DataFrame, key: str = "subject") -> DataFrame:
    """The key table without those subjects: whatever was sealed for them cannot be read again."""
    return keys.join(subjects, key, "left_anti")


def modular_encryption(spark: SparkSession, kms_client: str, footer_key: str, columns: dict[str, list[str]], plaintext_footer: bool = False) -> dict[str, str]:
    """Writer options for Parquet modular encryption; sets the key tools' factory and key service client on the session."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.crypto.factory.class", "org.apache.parquet.crypto.keytools.PropertiesDrivenCryptoFactory")
    conf.set("parquet.encryption.kms.client.class", kms_client)
    listed = ";".join(f"{k}:{','.join(c)}" for k, c in columns.items())
    return {"parquet.encryption.footer.key": footer_key, "parquet.encryption.column.keys": listed, "parquet.encryption.plaintext.footer": str(plaintext_footer).lower()}


def _crypto(masters: dict[str, bytes]):
    """A key tool factory over a key service that wraps keys under master keys held in memory; real services pass their own."""
    import base64

    import pyarrow.parquet.encryption as pe

    class Service(pe.KmsClient):
        def __init__(self, config):
            super().__init__()
            self.masters = {k: base64.b64decode(v) for k, v in config.custom_kms_conf.items()}

        def wrap_key(self, key_bytes, master_key_identifier):
            return base64.b64encode(wrapped(self.masters[master_key_identifier], key_bytes))

        def unwrap_key(self, wrapped_key, master_key_identifier):
            return unwrapped(self.masters[master_key_identifier], base64.b64decode(wrapped_key))

    config = pe.KmsConnectionConfig(custom_kms_conf={k: base64.b64encode(v).decode() for k, v in masters.items()})
    return pe.CryptoFactory(Service), config


def wrapped(master: bytes, key: bytes) -> bytes:
    """A key under a master key: a nonce, the key under a pad derived from both, and a tag over the two."""
    nonce = os.urandom(16)
    body = nonce + bytes(a ^ b for a, b in zip(key, hkdf(master, nonce, b"pad", len(key)), strict=True))
    return body + hmac.digest(hkdf(master, nonce, b"tag"), body, "sha256")


def unwrapped(master: bytes, sealed: bytes) -> bytes:
    body, tag = sealed[:-32], sealed[-32:]
    if not hmac.compare_digest(hmac.digest(hkdf(master, body[:16], b"tag"), body, "sha256"), tag):
        raise ValueError("wrong master key")
    return bytes(a ^ b for a, b in zip(body[16:], hkdf(master, body[:16], b"pad", len(body) - 16), strict=True))


def write_encrypted(df: DataFrame, path: str, masters: dict[str, bytes], footer_key: str, columns: dict[str, list[str]]) -> None:
    """Files with Parquet modular encryption, a file a task: the footer under one master key, columns under theirs. They appear when whole."""
    import pyarrow as pa

    from ..sources.tables import store_of

    store, folder = store_of(path)
    store.create_dir(folder, recursive=True)

    def run(batches):
        import pyarrow.parquet as pq
        import pyarrow.parquet.encryption as pe
        from pyspark import TaskContext

        store, folder = store_of(path)
        context, writer, rows = TaskContext.get(), None, 0
        name = f"part-{context.partitionId():05d}.parquet.encrypted"
        made = f"{folder}/.{name}-{context.taskAttemptId()}"
        factory, config = _crypto(masters)
        for batch in batches:
            if writer is None:
                how = pe.EncryptionConfiguration(footer_key=footer_key, column_keys=columns)
                file = store.open_output_stream(made)
                writer = pq.ParquetWriter(file, batch.schema, encryption_properties=factory.file_encryption_properties(config, how))
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            file.close()
            store.move(made, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    df.mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


def read_encrypted(spark: SparkSession, path: str, schema, masters: dict[str, bytes]) -> DataFrame:
    """Rows of such files, a file a task; row groups are read one after the other."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..sources.tables import store_of

    out = to_arrow_schema(schema)
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches):
        import pyarrow.parquet as pq

        factory, config = _crypto(masters)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, name = store_of(file)
                with store.open_input_file(name) as handle:
                    for part in pq.ParquetFile(handle, decryption_properties=factory.file_decryption_properties(config)).iter_batches():
                        yield part.select(out.names).cast(out)

    return files.mapInArrow(run, schema)
