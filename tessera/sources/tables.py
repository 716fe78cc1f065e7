"""Reading tables, and records of foreign formats into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.reports import first_given, useful_tags

from tessera.functions import web


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt (by keys, if given) over as many tasks as shuffles have, for heavy work: a packed file of few megabytes, read by one task, can hold millions of rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def first_existing(spark: SparkSession, *names: str) -> DataFrame:
    """The first of the named relations that exists; columns that are missing still raise."""
    for name in names:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    raise ValueError(f"none of {', '.join(names)} exists")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header; quotes are doubled, a byte-order mark is dropped by the header's name."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Daily filing index in fixed columns after a dashed line: form, company, entity, filed, file."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\d{8}\s+edgar/|\d{4}-\d{2}-\d{2}\s+edgar/"))
    parts = F.split(F.trim("value"), r"\s{2,}")
    return lines.select(
        F.get(parts, F.lit(0)).alias("form_type"),
        F.get(parts, F.lit(1)).alias("company"),
        F.get(parts, F.lit(2)).alias("entity_number"),
        F.coalesce(F.try_to_date(F.get(parts, F.lit(3)), "yyyyMMdd"), F.try_to_date(F.get(parts, F.lit(3)), "yyyy-MM-dd")).alias("filed"),
        F.get(parts, F.lit(4)).alias("file"),
    )


def offering_notice(xml: Column) -> Column:
    """Struct of the fields of an exempt-offering notice (XML)."""

    def text(path: str) -> Column:
        return F.nullif(F.trim(F.xpath_string(xml, F.lit(f"//{path}/text()"))), F.lit(""))

    def amount(path: str) -> Column:
        return F.try_to_number(F.when(text(path).rlike(r"^\d+(\.\d+)?$"), text(path)), F.lit("9999999999999999D99")).cast("double")

    people = F.zip_with(F.xpath(xml, F.lit("//relatedPersonName/firstName/text()")), F.xpath(xml, F.lit("//relatedPersonName/lastName/text()")), lambda a, b: F.concat_ws(" ", a, b))
    return F.struct(
        text("entityName").alias("entity_name"),
        text("cik").alias("entity_number"),
        text("industryGroupType").alias("industry_group"),
        text("investmentFundType").alias("fund_type"),
        amount("totalOfferingAmount").alias("total_offering"),
        amount("totalAmountSold").alias("total_sold"),
        people.alias("officers"),
    )


#: The job row that every board is read into.
JOB_COLUMNS = ("external_job_id", "title", "url", "location", "department", "posted_at")
#: For each board: the path of its list, and of each job column within an item (several: the first that is there).
BOARDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "greenhouse": ("$.jobs", ("$.id", "$.title", "$.absolute_url", "$.location.name", "$.departments[0].name", "$.updated_at")),
    "lever": ("$", ("$.id", "$.text", "$.hostedUrl", "$.categories.location", "$.categories.team", "$.createdAt")),
    "ashby": ("$.jobs", ("$.id", "$.title", "$.jobUrl", "$.location", "$.department", "$.publishedAt")),
    "workable": ("$.jobs", ("$.shortcode", "$.title", "$.url", "$.city", "$.department", "$.published_on")),
    "comeet": ("$", ("$.uid", "$.name", "$.url_active_page", "$.location.name", "$.department", "$.time_updated")),
    "smartrecruiters": ("$.content", ("$.id", "$.name", "$.ref", "$.location.city", "$.department.label", "$.releasedDate")),
    "recruitee": ("$.offers", ("$.id", "$.title", "$.careers_url", "$.location", "$.department", "$.created_at")),
    "teamtailor": ("$.items", ("$.id", "$.title", "$.url", "$._jobposting.jobLocation[0].address.addressLocality", "$.department", "$.date_published")),
}


def read_board(responses: DataFrame, provider: str, *, body: str = "body") -> DataFrame:
    """Job rows of a provider's responses (JSON text in ``body``); of repeated job ids the first, links only to the web."""
    listing, paths = BOARDS[provider]
    items = F.expr(f"try_variant_get(try_parse_json(`{body}`), '{listing}', 'array<variant>')")
    exploded = responses.select(*[c for c in responses.columns if c != body], F.posexplode(items).alias("position", "item"))
    fields = [F.expr(f"try_variant_get(item, '{path}', 'string')").alias(name) for name, path in zip(JOB_COLUMNS, paths)]
    kept = [c for c in responses.columns if c != body]
    rows = exploded.select(*kept, "position", *fields).where(F.col("external_job_id").isNotNull() & F.col("title").isNotNull())
    first = rows.groupBy(*kept, "external_job_id").agg(F.min_by(F.struct("title", "url", "location", "department", "posted_at"), "position").alias("job"))
    out = first.select(*kept, "external_job_id", "job.*")
    return out.withColumn("url", F.when(web.is_web_link(F.col("url")), F.col("url"))).withColumn("provider", F.lit(provider))


def read_personio(responses: DataFrame, *, body: str = "body") -> DataFrame:
    """Job rows of an XML board."""

    def each(path: str) -> Column:
        return F.xpath(F.col(body), F.lit(f"//position/{path}/text()"))

    zipped = F.arrays_zip(each("id").alias("external_job_id"), each("name").alias("title"), each("office").alias("location"), each("department").alias("department"))
    kept = [c for c in responses.columns if c != body]
    return responses.select(*kept, F.explode(zipped).alias("job")).select(*kept, "job.*", F.lit("personio").alias("provider"))


def company_record(body: Column) -> Column:
    """Struct of a company register's JSON item; the first key that is there wins."""
    v = F.try_parse_json(body)

    def pick(*paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])

    return F.struct(
        pick("$.company_number", "$.number").alias("entity_number"),
        pick("$.company_name", "$.title").alias("entity_name"),
        F.try_to_date(pick("$.date_of_creation", "$.incorporated_on"), "yyyy-MM-dd").alias("incorporated"),
        F.try_variant_get(v, "$.sic_codes", "array<string>").alias("codes"),
        pick("$.company_status", "$.status").alias("status"),
    )


def repository_record(body: Column, as_of: Column) -> Column:
    """Struct of a code host's repository item, with its age in days."""
    v = F.try_parse_json(body)
    created = F.try_to_timestamp(F.try_variant_get(v, "$.created_at", "string"))
    return F.struct(
        F.try_variant_get(v, "$.full_name", "string").alias("external_id"),
        F.lower(F.try_variant_get(v, "$.owner.login", "string")).alias("owner_login"),
        F.try_variant_get(v, "$.owner.type", "string").alias("owner_type"),
        F.try_variant_get(v, "$.stargazers_count", "int").alias("stars"),
        F.try_variant_get(v, "$.forks_count", "int").alias("forks"),
        F.nullif(F.try_variant_get(v, "$.homepage", "string"), F.lit("")).alias("homepage"),
        created.alias("created_at"),
        F.datediff(as_of, created).alias("age_days"),
    )


def model_record(body: Column) -> Column:
    """Struct of a model hub's item: its name cut at the first slash, useful tags, and whether it is closed; null without a name."""
    v = F.try_parse_json(body)
    name = first_given(v, "id", "modelId")
    slash = F.instr(name, "/")
    yes = [F.coalesce(F.try_variant_get(v, f"$.{k}", "boolean"), F.lit(False)) for k in ("private", "gated", "disabled")]
    return F.when(
        name.isNotNull(),
        F.struct(
            name.alias("external_id"),
            F.when(slash > 1, F.substring_index(name, "/", 1)).otherwise(F.coalesce(first_given(v, "author"), F.lit(""))).alias("owner"),
            F.when(slash > 1, F.substr(name, slash + 1)).otherwise(name).alias("name"),
            F.try_variant_get(v, "$.likes", "double").alias("likes"),
            F.try_variant_get(v, "$.downloads", "double").alias("downloads"),
            useful_tags(F.try_variant_get(v, "$.tags", "array<string>")).alias("tags"),
            first_given(v, "pipeline_tag").alias("task"),
            (yes[0] | yes[1] | yes[2]).alias("closed"),
        ),
    )


def publication_record(v: Column) -> Column:
    """Struct of a patent publication, parsed as a variant; each field is the first given of its spellings.  Null without a number."""
    number = first_given(v, "publication_number", "document_number", "pgpub_id", "publication_id")

    def listed(*names: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "array<variant>") for n in names], F.array().cast("array<variant>"))

    def person(x: Column) -> Column:
        parts = [first_given(x, "inventor_name_first", "first_name", "given_name"), first_given(x, "inventor_name_last", "last_name", "family_name")]
        return F.coalesce(first_given(x, "inventor_name", "name"), F.nullif(F.concat_ws(" ", *parts), F.lit("")))

    owners = F.transform(listed("assignees", "assignee"), lambda x: first_given(x, "assignee_organization", "assignee_org_name", "organization", "name"))
    return F.when(
        number.isNotNull(),
        F.struct(
            number.alias("publication_number"),
            first_given(v, "application_number", "appl_id", "application_id").alias("application_number"),
            first_given(v, "patent_title", "title", "invention_title").alias("title"),
            F.try_to_date(first_given(v, "publication_date", "date_published", "pub_date"), "yyyy-MM-dd").alias("published"),
            F.coalesce(first_given(v, "assignee_organization", "assignee_org_name"), F.get(F.filter(owners, F.isnotnull), F.lit(0))).alias("assignee"),
            F.filter(F.transform(listed("inventors", "inventor"), person), F.isnotnull).alias("inventors"),
        ),
    )


def classification_symbol(section: Column, cls: Column, subclass: Column, group: Column, subgroup: Column) -> Column:
    """Patent class written as in ``G06F16/245``."""
    return F.concat(section, cls, subclass, group, F.lit("/"), subgroup)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quoted where needed, quotes doubled, nulls empty."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
