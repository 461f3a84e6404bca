"""Payment documents: accounts, payment events and outcomes as three tables (clock in minutes)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.scalars import (
    convert_currency,
    finite_number,
    to_micros,
    to_seconds,
    tri_label,
)
from ledgerlark.plans.ordering import first_seen_index, running_max
from ledgerlark.plans.prefix import global_rank, with_scalars
from ledgerlark.schema import Stream, payments_of
from ledgerlark.session import cut_lineage
from ledgerlark.sources.csv_layouts import BAD, SEQ, refuse, scan_csv_files


@dataclass(frozen=True)
class PaymentDocument:
    """``accounts(id, external_id, name)``,
    ``events(id, kind, t, u, v, amount, settled, reference, seq)`` with u = -1 for deposits and
    reports, ``outcomes(id, label, available_at)`` for payments of known outcome."""

    accounts: DataFrame
    events: DataFrame
    outcomes: DataFrame


JSON_SCHEMA = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField(
            "units",
            T.StructType(
                [T.StructField("time", T.StringType()), T.StructField("currency", T.StringType())]
            ),
        ),
        T.StructField(
            "accounts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("external_id", T.StringType()),
                        T.StructField("name", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "events",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("kind", T.StringType()),
                        T.StructField("t", T.DoubleType()),
                        T.StructField("u", T.LongType()),
                        T.StructField("v", T.LongType()),
                        T.StructField("amount", T.DoubleType()),
                        T.StructField("settled", T.BooleanType()),
                        T.StructField("reference", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("truth", T.MapType(T.StringType(), T.StringType())),
        T.StructField("label_available_at", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def read_payment_json(spark: SparkSession, path: str, check: bool = True) -> PaymentDocument:
    """One JSON document per file. A document is one record, so its size is bounded by the format;
    large histories are kept as tables (``export_payment_document``)."""
    document = spark.read.schema(JSON_SCHEMA).option("multiLine", True).json(path)
    accounts = document.select(F.inline("accounts")).withColumn(
        "external_id", F.coalesce("external_id", F.col("id").cast("string"))
    )
    accounts = accounts.withColumn("name", F.coalesce("name", "external_id"))
    events = document.select(F.posexplode("events").alias("seq", "e")).select(
        "e.*", F.col("seq").cast("bigint").alias("seq")
    )
    truth = document.select(F.explode("truth").alias("id", "text"))
    available = document.select(F.explode("label_available_at").alias("id", "available_at"))
    outcomes = (
        truth.join(available, "id", "full")
        .select("id", tri_label(F.col("text")).alias("label"), "available_at", F.col("text").alias("__t"))
    )
    result = PaymentDocument(accounts, events, outcomes.drop("__t"))
    if check:
        refuse(document_violations(result))
    return PaymentDocument(accounts, events, result.outcomes.filter("label >= 0"))


def _broken(good: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; a rule without a value is broken."""
    named = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in good.items()]
    return F.explode(F.filter(F.array(*named), lambda r: r.isNotNull())).alias("rule")


def _account_sizes() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi"),
        F.count_distinct("external_id").alias("x"),
    ]


def _account_rules() -> dict[str, Column]:
    span = (F.col("n") == F.col("d")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    return {
        "accounts-none": F.col("n") > 0,
        "account-gaps": (F.col("n") == 0) | span,
        "account-name-repeated": F.col("x") == F.col("n"),
    }


def _event_rules() -> dict[str, Column]:
    sender = (F.col("u") >= -1) & (F.col("u") < F.col("__accounts"))
    recipient = (F.col("v") >= 0) & (F.col("v") < F.col("__accounts"))
    finite = finite_number(F.col("t"), True).isNotNull() & finite_number(F.col("amount"), True).isNotNull()
    return {
        "event-id": F.col("id") != "",
        "time-or-amount": finite,
        "event-account": sender & recipient & (F.col("u") != F.col("v")),
        "event-kind": F.col("kind").isin("payment", "deposit", "report"),
        "sender-kind": (F.col("kind") == "payment") == (F.col("u") >= 0),
        "event-order": F.coalesce(F.col("t") >= F.col("__latest"), F.lit(True)),
    }


def _outcome_rules() -> dict[str, Column]:
    known = F.coalesce(F.col("label") >= 0, F.lit(False))
    return {
        "outcome-unpaid": F.col("__t").isNotNull(),
        "availability-unlabelled": F.col("available_at").isNull() | known,
        "availability-early": F.coalesce(F.col("available_at") >= F.col("__t"), F.lit(True)),
    }


def document_violations(document: PaymentDocument) -> DataFrame:
    """One row (event_id, arrival_seq, rule) per broken rule of a payment document.

    Codes of the accounts: ``accounts-none``, ``account-gaps`` (ids are not 0 to n - 1), ``account-name-repeated``; of an
    event: ``event-id``, ``time-or-amount``, ``event-account``, ``event-kind``, ``sender-kind`` (a payment without a
    sender or the reverse), ``event-order``, ``event-id-repeated``; of an outcome: ``outcome-unpaid`` (of no payment),
    ``availability-unlabelled``, ``availability-early``.
    """
    accounts, events, outcomes = document.accounts, document.events, document.outcomes
    size = accounts.agg(*_account_sizes())
    none = F.lit(-1).cast("bigint").alias("arrival_seq")
    account_rules = size.select(F.lit("accounts").alias("event_id"), none, _broken(_account_rules()))
    count = size.select(F.col("n").alias("__accounts"))
    ordered = with_scalars(running_max(events, ["seq"], "t", "__latest"), count)
    event_rules = ordered.select(F.col("id").alias("event_id"), F.col("seq").alias("arrival_seq"), _broken(_event_rules()))
    twice = (
        events.groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("arrival_seq"))
        .filter("n > 1")
        .select(F.col("id").alias("event_id"), "arrival_seq", F.lit("event-id-repeated").alias("rule"))
    )
    paid = events.filter("kind = 'payment'").select("id", F.col("t").alias("__t"))
    outcome_rules = outcomes.join(paid, "id", "left").select(F.col("id").alias("event_id"), none, _broken(_outcome_rules()))
    return account_rules.unionByName(event_rules).unionByName(twice).unionByName(outcome_rules)


@dataclass(frozen=True)
class PaymentDocuments:
    """Many documents side by side: the tables of ``PaymentDocument``, each with a column ``document``, and
    ``documents(document)`` with a row per record that was read, also of one that holds nothing."""

    documents: DataFrame
    accounts: DataFrame
    events: DataFrame
    outcomes: DataFrame


def read_payment_documents(spark: SparkSession, path: str | Sequence[str], lines: bool = True, check: bool = True) -> PaymentDocuments:
    """Any number of payment documents, parsed where their files lie.

    With ``lines`` every line of the files is a document and goes by its ``name``; otherwise every file is one
    and goes by its path. Account indices, event ids, clocks and the order of events belong to a document, so nothing
    is compared across documents and a window holds one document. With ``check`` the first broken rule raises;
    a record that can't be parsed, a missing and a repeated name are broken rules. Outcomes keep known labels.
    """
    raw = spark.read.schema(JSON_SCHEMA).option("multiLine", not lines).json(path)
    parsed = raw.withColumn("document", F.col("name") if lines else F.col("_metadata.file_path"))
    documents = parsed.select("document")
    accounts = parsed.select("document", F.inline("accounts")).withColumn(
        "external_id", F.coalesce("external_id", F.col("id").cast("string"))
    )
    accounts = accounts.withColumn("name", F.coalesce("name", "external_id"))
    events = parsed.select("document", F.posexplode("events").alias("seq", "e")).select(
        "document", "e.*", F.col("seq").cast("bigint").alias("seq")
    )
    truth, available = F.col("truth"), F.col("label_available_at")
    known = F.array_union(F.coalesce(F.map_keys(truth), F.array()), F.coalesce(F.map_keys(available), F.array()))
    outcomes = parsed.select("document", truth, available, F.explode(known).alias("id")).select(
        "document", "id", tri_label(F.try_element_at(truth, F.col("id"))).alias("label"),
        F.try_element_at(available, F.col("id")).alias("available_at"),
    )
    result = PaymentDocuments(documents, accounts, events, outcomes)
    if check:
        first = documents_violations(result).orderBy("document", "arrival_seq", "event_id", "rule").limit(1).collect()
        for row in first:
            raise ValueError(f"document {row['document']!r}, row {row['arrival_seq']}: event {row['event_id']!r}: {row['rule']}")
    return PaymentDocuments(documents, accounts, events, outcomes.filter("label >= 0"))


def documents_violations(documents: PaymentDocuments) -> DataFrame:
    """One row (document, event_id, arrival_seq, rule) per broken rule, document by document."""
    none = F.lit(-1).cast("bigint").alias("arrival_seq")
    records = documents.documents.groupBy("document").agg(F.count(F.lit(1)).alias("r"))
    record_rules = records.select("document", F.lit("").alias("event_id"), none, _broken({
        "document-unnamed": F.col("document").isNotNull(), "document-name-repeated": F.col("r") == 1,
    }))
    sizes = documents.accounts.groupBy("document").agg(*_account_sizes())
    counted = records.filter("document is not null").join(sizes, "document", "left").fillna(0, ["n", "d", "x"])
    account_rules = counted.select("document", F.lit("accounts").alias("event_id"), none, _broken(_account_rules()))
    before = Window.partitionBy("document").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ordered = documents.events.withColumn("__latest", F.max("t").over(before)).join(
        counted.select("document", F.col("n").alias("__accounts")), "document"
    )
    event_rules = ordered.select(
        "document", F.col("id").alias("event_id"), F.col("seq").alias("arrival_seq"), _broken(_event_rules())
    )
    twice = (
        documents.events.groupBy("document", "id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("arrival_seq"))
        .filter("n > 1")
        .select("document", F.col("id").alias("event_id"), "arrival_seq", F.lit("event-id-repeated").alias("rule"))
    )
    paid = documents.events.filter("kind = 'payment'").select("document", "id", F.col("t").alias("__t"))
    outcome_rules = documents.outcomes.join(paid, ["document", "id"], "left").select(
        "document", F.col("id").alias("event_id"), none, _broken(_outcome_rules())
    )
    parts = (account_rules, event_rules, twice, outcome_rules)
    return reduce(DataFrame.unionByName, parts, record_rules)


def write_payment_documents(documents: PaymentDocuments, path: str, per_file: int = 1000) -> None:
    """Write documents as lines (see ``read_payment_documents``), at most about ``per_file`` of them in a file.

    A document is one record, so its caller bounds it, for instance by an account or a stretch of time. Records are
    put together in many tasks; outcomes are ``(document, id, label, available_at)``.
    """
    n = documents.documents.count()
    fields = ["id", "kind", "t", "u", "v", "amount", "settled", "reference"]
    keyed = lambda value: F.struct("id", value.alias("x"))
    entries = lambda c: F.map_from_entries(F.array_sort(c))
    accounts = documents.accounts.groupBy("document").agg(
        F.array_sort(F.collect_list(F.struct("id", "external_id", "name"))).alias("accounts")
    )
    events = documents.events.groupBy("document").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", *fields))), lambda e: e.dropFields("seq")).alias("events")
    )
    outcomes = documents.outcomes.groupBy("document").agg(
        entries(F.collect_list(keyed(F.col("label").cast("boolean")))).alias("truth"),
        entries(F.collect_list(F.when(F.col("available_at").isNotNull(), keyed(F.col("available_at"))))).alias("label_available_at"),
    )
    whole = documents.documents.withColumn("name", F.col("document"))
    for part in (accounts, events, outcomes):
        whole = whole.join(part, "document", "left")
    whole.drop("document").repartition(max(1, -(-n // per_file))).write.json(path)


def read_payment_csv(
    spark: SparkSession,
    paths,
    columns: dict[str, str],
    time_unit: str = "seconds",
    label_values: dict | None = None,
    currency: str = "EUR",
    check: bool = True,
) -> PaymentDocument:
    """Mapped payment CSV: the clock starts at the first event and counts minutes; accounts are
    numbered by first appearance in the file, senders before recipients."""
    required = ["id", "time", "sender", "recipient", "amount"]
    if any(key not in columns for key in required):
        raise ValueError(f"columns: no column is given for {', '.join(k for k in required if k not in columns)}")
    if currency != "EUR":
        raise ValueError(f"currency: amounts in {currency} go through convert_currency first")
    raw = scan_csv_files(spark, paths, list(columns.values()))

    def text(key: str):
        return F.trim(F.col(columns[key]))

    kind = text("kind") if "kind" in columns else F.lit("payment")
    paid = kind == "payment"
    label = (
        F.when(paid, tri_label(F.col(columns["label"]), label_values)).otherwise(-1)
        if "label" in columns
        else F.lit(-1)
    )
    settled = F.lit(None).cast("boolean")
    if "settled" in columns:
        lowered = F.lower(text("settled"))
        settled = F.when(lowered.isin("true", "1"), True).when(lowered.isin("false", "0"), False)
    available = F.lit(None).cast("double")
    if "label_available_at" in columns:
        available = F.when(
            (text("label_available_at") != "") & (label >= 0),
            to_seconds(F.col(columns["label_available_at"]), time_unit),
        )
    # Parsed once: ids, origin, order and checks all read the rows again.
    rows = raw.select(
        text("id").alias("id"),
        kind.alias("kind"),
        to_seconds(F.col(columns["time"]), time_unit).alias("__time"),
        F.when(paid, text("sender")).alias("__sender"),
        text("recipient").alias("__recipient"),
        finite_number(F.col(columns["amount"])).alias("amount"),
        settled.alias("settled"),
        (F.col(columns["reference"]) if "reference" in columns else F.lit(None).cast("string")).alias(
            "reference"
        ),
        label.alias("label"),
        available.alias("__available"),
        F.col(SEQ).alias("__row"),
        F.col(BAD).alias("__bad"),
    )
    rows = cut_lineage(rows)
    if check:
        wrong = (
            F.col("__bad").isNotNull()
            | F.col("__time").isNull()
            | F.col("amount").isNull()
            | F.col("label").isNull()
            | (F.coalesce(F.col("__recipient"), F.lit("")) == "")
            | ((F.col("kind") == "payment") & (F.coalesce(F.col("__sender"), F.lit("")) == ""))
        )
        if "settled" in columns:
            wrong = wrong | F.col("settled").isNull()
        refuse(
            rows.filter(wrong).select(
                F.col("id").alias("event_id"),
                F.col("__row").alias("arrival_seq"),
                F.lit("every mapped column must be readable").alias("rule"),
            )
        )
    index = first_seen_index(rows, [F.col("__sender"), F.col("__recipient")], ["__row"], "id")
    accounts = index.select("id", F.col("key").alias("external_id"), F.col("key").alias("name"))
    origin = rows.agg(F.min("__time").alias("__origin"))
    timed = with_scalars(rows, origin)
    senders = index.select(F.col("key").alias("__sender"), F.col("id").alias("u"))
    recipients = index.select(F.col("key").alias("__recipient"), F.col("id").alias("v"))
    joined = timed.join(senders, "__sender", "left").join(recipients, "__recipient", "left")
    minutes = (F.col("__time") - F.col("__origin")) / 60
    events = global_rank(
        joined.withColumn("t", minutes).withColumn("__us", to_micros(F.col("__time"))),
        ["__us", "__row"],
        "seq",
    )
    result = PaymentDocument(
        accounts,
        events.select(
            "id", "kind", "t", F.coalesce("u", F.lit(-1)).cast("bigint").alias("u"), "v", "amount",
            "settled", "reference", "seq",
        ),
        timed.filter("label >= 0").select(
            "id", "label", ((F.col("__available") - F.col("__origin")) / 60).alias("available_at")
        ),
    )
    if check:
        refuse(document_violations(result))
    return result


def document_payments(document: PaymentDocument, unit_seconds: float = 60.0) -> DataFrame:
    """Flat payments of a document, keyed by account index, in time and arrival order."""
    return document.events.select(
        F.col("id").alias("event_id"),
        to_micros(F.col("t") * unit_seconds).alias("event_us"),
        "seq",
        "kind",
        F.when(F.col("u") >= 0, F.col("u").cast("string")).alias("source"),
        F.col("v").cast("string").alias("destination"),
        "amount",
        "settled",
    )


def payments_view(
    stream: Stream, amount_to_eur: float | None = None, start: float | None = None, stop: float | None = None
) -> PaymentDocument:
    """Event stream as a payment document: minutes, EUR, accounts by first appearance in time."""
    amount = convert_currency(F.col("amount"), stream.descriptor.currency, amount_to_eur)
    flat = payments_of(stream, (stream.descriptor.dataset_id, stream.descriptor.version))
    if start is not None:
        flat = flat.filter(F.col("event_us") >= round(start * 1e6))
    if stop is not None:
        flat = flat.filter(F.col("event_us") < round(stop * 1e6))

    index = first_seen_index(
        flat, [F.col("source"), F.col("destination")], ["event_us", "seq"], "id"
    )
    parts = F.from_json("key", "array<string>")
    accounts = index.select(
        "id",
        F.col("key").alias("external_id"),
        F.concat_ws(" ", F.element_at(parts, 3), F.element_at(parts, 4)).alias("name"),
    )
    senders = index.select(F.col("key").alias("source"), F.col("id").alias("u"))
    recipients = index.select(F.col("key").alias("destination"), F.col("id").alias("v"))
    events = global_rank(
        flat.join(senders, "source")
        .join(recipients, "destination")
        .withColumnRenamed("seq", "__arrival"),
        ["event_us", "__arrival"],
        "seq",
    ).select(
        F.col("event_id").alias("id"),
        "kind",
        (F.col("event_us") / 60e6).alias("t"),
        "u",
        "v",
        amount.alias("amount"),
        F.lit(None).cast("boolean").alias("settled"),
        F.lit(None).cast("string").alias("reference"),
        "seq",
    )
    outcomes = (
        stream.outcomes.filter("label >= 0")
        .join(flat.select("event_id"), "event_id", "left_semi")
        .select(
            F.col("event_id").alias("id"), "label", (F.col("available_at") / 60).alias("available_at")
        )
    )
    return PaymentDocument(accounts, events, outcomes)


def select_payment_interval(
    document: PaymentDocument, start: float | None = None, stop: float | None = None
) -> PaymentDocument:
    """Half-open interval in seconds; outcomes restricted to it; accounts compacted in id order."""
    events = document.events
    if start is not None:
        events = events.filter(F.col("t") * 60 >= start)
    if stop is not None:
        events = events.filter(F.col("t") * 60 < stop)
    active = (
        events.select(F.explode(F.array("u", "v")).alias("old")).filter("old >= 0").distinct()
    )
    index = global_rank(active, ["old"], "new")
    accounts = document.accounts.join(index, F.col("id") == F.col("old")).select(
        F.col("new").alias("id"), "external_id", "name"
    )
    senders = index.select(F.col("old").alias("u"), F.col("new").alias("__u"))
    recipients = index.select(F.col("old").alias("v"), F.col("new").alias("__v"))
    moved = events.join(senders, "u", "left").join(recipients, "v")
    kept = events.filter("kind = 'payment'").select("id")
    return PaymentDocument(
        accounts,
        moved.select(
            "id", "kind", "t", F.coalesce("__u", F.lit(-1)).cast("bigint").alias("u"),
            F.col("__v").alias("v"), "amount", "settled", "reference", "seq",
        ),
        document.outcomes.join(kept, "id", "left_semi"),
    )


def compose_episodes(
    episodes: Sequence[PaymentDocument], gap_minutes: float = 60.0
) -> tuple[PaymentDocument, DataFrame]:
    """Concatenate independent histories; the second result lists each episode's time bounds.

    The number of episodes is the length of the argument, so their bounds are collected.
    """
    if not episodes:
        raise ValueError("episodes: the list is empty")
    if not 0 < gap_minutes < 1e9:
        raise ValueError(f"gap_minutes: {gap_minutes} is no length of time between episodes")
    stats = None
    for number, episode in enumerate(episodes, 1):
        size = episode.accounts.agg(F.count(F.lit(1)).alias("accounts"))
        span = episode.events.agg(
            F.min("t").alias("first"), F.max("t").alias("last"), F.max("seq").alias("top")
        )
        row = with_scalars(span, size).withColumn("episode", F.lit(number))
        stats = row if stats is None else stats.unionByName(row)
    found = {r["episode"]: r for r in stats.collect()}
    offset, accounts_before, seq_before = 0.0, 0, 0
    tables: list[PaymentDocument] = []
    bounds = []
    for number, episode in enumerate(episodes, 1):
        row = found[number]
        prefix, shift = f"episode-{number}:", offset - row["first"]
        end = row["last"] + shift
        add, seq = F.lit(accounts_before), F.lit(seq_before)
        named = F.lit(prefix)
        tables.append(
            PaymentDocument(
                episode.accounts.select(
                    (F.col("id") + add).cast("bigint").alias("id"),
                    F.concat(named, "external_id").alias("external_id"),
                    "name",
                ),
                episode.events.select(
                    F.concat(named, "id").alias("id"),
                    "kind",
                    (F.col("t") + F.lit(shift)).alias("t"),
                    F.when(F.col("u") >= 0, F.col("u") + add).otherwise(-1).cast("bigint").alias("u"),
                    (F.col("v") + add).cast("bigint").alias("v"),
                    "amount",
                    "settled",
                    F.concat(named, "reference").alias("reference"),
                    (F.col("seq") + seq).cast("bigint").alias("seq"),
                ),
                episode.outcomes.select(
                    F.concat(named, "id").alias("id"),
                    "label",
                    (F.col("available_at") + F.lit(shift)).alias("available_at"),
                ),
            )
        )
        bounds.append((number, offset, end))
        offset = end + gap_minutes
        accounts_before += row["accounts"]
        seq_before += row["top"] + 1
    whole = tables[0]
    for nxt in tables[1:]:
        whole = PaymentDocument(
            whole.accounts.unionByName(nxt.accounts),
            whole.events.unionByName(nxt.events),
            whole.outcomes.unionByName(nxt.outcomes),
        )
    spark = whole.events.sparkSession
    listing = spark.createDataFrame(
        bounds, "episode int, start_minutes double, end_minutes double"
    )
    return whole, listing


def export_payment_document(document: PaymentDocument, path: str) -> None:
    """Write the three tables of a document as JSON lines below one new folder."""
    document.accounts.write.mode("errorifexists").json(f"{path}/accounts")
    document.events.write.mode("errorifexists").json(f"{path}/events")
    document.outcomes.write.mode("errorifexists").json(f"{path}/outcomes")


def import_payment_document(spark: SparkSession, path: str) -> PaymentDocument:
    """Read back what ``export_payment_document`` wrote."""
    outcomes = T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("label", T.IntegerType()),
            T.StructField("available_at", T.DoubleType()),
        ]
    )
    element = JSON_SCHEMA["events"].dataType.elementType
    return PaymentDocument(
        spark.read.schema(JSON_SCHEMA["accounts"].dataType.elementType).json(f"{path}/accounts"),
        spark.read.schema(T.StructType([*element.fields, T.StructField("seq", T.LongType())])).json(
            f"{path}/events"
        ),
        spark.read.schema(outcomes).json(f"{path}/outcomes"),
    )


def report_availability(document: PaymentDocument) -> DataFrame:
    """Availability of a label: the earliest report event that references the payment."""
    reported = (
        document.events.filter((F.col("kind") == "report") & F.col("reference").isNotNull())
        .groupBy(F.col("reference").alias("id"))
        .agg(F.min("t").alias("available_at"))
    )
    return reported.join(document.outcomes.filter("label >= 0").select("id"), "id", "left_semi")
