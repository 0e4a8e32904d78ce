"""A registry derived by Spark from the given order tables.

No trial data is supplied, so an order plays the trial, its customer the
sponsor and its line items the contacts. Every derived column is a function of
one order row, of its dimension rows or of a decomposable aggregate of its
items (min, count, sum), so no order is ever collected, however many items it
has. Only the dimensions that the asked-for columns need are joined.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.registry import Registry, new_registry
from ..staging import stage

AS_OF = dt.date(2001, 8, 2)


def choose(column: str, mapping: dict, otherwise=None, kind: str = "long") -> Column:
    case = F.lit(otherwise)
    for value, result in reversed(mapping.items()):
        case = F.when(F.col(column) == value, F.lit(result)).otherwise(case)
    return case.cast(kind)


STATUS = {"F": "published", "O": "approved"}
RECRUITMENT = {"1-URGENT": 2, "2-HIGH": 1, "4-NOT SPECIFIED": 9, "5-LOW": 5}
STUDY_TYPE = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 1, "MACHINERY": 2}
PHASE = {"AFRICA": 1, "AMERICA": 9, "ASIA": 3, "EUROPE": 6}


def _free_text() -> Column:
    return F.concat(
        "names",
        F.when(F.col("items") == 1, F.concat(F.lit("; "), F.upper("p_name"))).otherwise(""),
        F.lit(" | "), "p_brand", F.lit(", "), F.lower("p_type"), F.lit(" ;"),
        F.substr("o_orderpriority", F.lit(3)), F.lit(","), F.col("p_size").cast("string"), F.lit(".50|"),
        F.when(F.col("c_acctbal") < 0, F.lit("Oral  ")).otherwise(""), "c_mktsegment", F.lit(".;"),
        "r_name", F.lit("."),
    )


def _key() -> Column:
    return F.col("o_orderkey").cast("string")


def _no_text() -> Column:
    return F.lit(None).cast("string")


# Column -> (expression, tables needed besides orders).
TRIAL_COLUMNS: dict[str, tuple[Callable[[], Column], tuple[str, ...]]] = {
    "id": (lambda: F.col("o_orderkey"), ()),
    "trial_id": (lambda: F.concat(F.lit("RBR-"), _key()), ()),
    "utrn": (lambda: F.concat(F.lit("U"), F.col("o_custkey").cast("string")), ()),
    "reg_name": (lambda: F.lit("GIVEN"), ()),
    "status": (lambda: choose("o_orderstatus", STATUS, "under_review", "string"), ()),
    "date_registration": (lambda: F.col("o_orderdate").cast("date"), ()),
    "date_enrolment": (lambda: F.col("first_ship"), ("items",)),
    "primary_sponsor": (
        lambda: F.when(F.col("c_acctbal") < 0, F.lit(" ")).otherwise(F.col("c_name")), ("customer",),
    ),
    "public_title": (
        lambda: F.concat("p_name", F.lit(" | "), "p_type", F.lit("\n"), "o_orderpriority"), ("items", "part"),
    ),
    "acronym": (_no_text, ()),
    "scientific_title": (lambda: F.concat(F.lit("Study of "), "p_name"), ("items", "part")),
    "scientific_acronym": (_no_text, ()),
    "type_enrolment_id": (lambda: choose("o_orderstatus", {"F": 2, "O": 1}), ()),
    "target_size": (lambda: F.col("quantity").cast("int"), ("items",)),
    "recruitment_status_id": (lambda: choose("o_orderpriority", RECRUITMENT), ()),
    "study_type_id": (lambda: choose("c_mktsegment", STUDY_TYPE), ("customer",)),
    "phase_id": (lambda: choose("r_name", PHASE), ("customer", "region")),
    "hc_freetext": (_free_text, ("items", "names", "part", "customer", "region")),
    "i_freetext": (_no_text, ()),
    "url": (
        lambda: F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(
            F.concat(F.lit("https://example.org/trial/"), _key())
        ),
        ("customer",),
    ),
}


class GivenTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, DataFrame] = {}
        self._element_orders: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def items(self) -> DataFrame:
        """Line items per order; all aggregates combine on the map side."""
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.min("l_shipdate").cast("date").alias("first_ship"),
            F.min("l_partkey").alias("p_partkey"),
            F.count(F.lit(1)).alias("items"),
            F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
        )

    def item_names(self) -> DataFrame:
        """The distinct part names of each order's items; combined on the map side, bounded by the order's parts."""
        named = self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(self.table("part"), "p_partkey")
        names = F.array_join(F.array_sort(F.collect_set("p_name")), "; ")
        return named.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(names.alias("names"))

    def orders(self, *needs: str) -> DataFrame:
        """The orders with what these tables add to them.

        Customers and parts are joined to narrow rows; the names, the widest column,
        come last, so they are shuffled once, to their order.
        """
        df = self.table("orders")
        if "customer" in needs or "region" in needs:
            customer = self.table("customer").withColumnRenamed("c_custkey", "o_custkey")
            if "region" in needs:
                nation = self.table("nation").withColumnRenamed("n_nationkey", "c_nationkey")
                region = self.table("region").withColumnRenamed("r_regionkey", "n_regionkey")
                customer = customer.join(nation, "c_nationkey", "left").join(region, "n_regionkey", "left")
            df = df.join(customer, "o_custkey", "left")
        if "items" in needs or "part" in needs:
            items = self.items()
            if "part" in needs:
                items = items.join(self.table("part"), "p_partkey", "left")
            df = df.join(items, "o_orderkey", "left")
        if "names" in needs:
            df = df.join(self.item_names(), "o_orderkey", "left")
        return df

    def trial(self, *columns: str) -> DataFrame:
        """The trial table with these columns (all of them by default)."""
        columns = columns or tuple(TRIAL_COLUMNS)
        needs = {need for c in columns for need in TRIAL_COLUMNS[c][1]}
        return self.orders(*needs).select(*[TRIAL_COLUMNS[c][0]().alias(c) for c in columns])

    def study_design(self) -> DataFrame:
        return self.orders("items", "customer").select(
            F.col("o_orderkey").alias("trial_id"),
            choose("o_orderstatus", {"F": 1, "O": 2}).alias("expanded_access_id"),
            choose("o_orderpriority", {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 9}).alias("study_focus_id"),
            choose("c_mktsegment", {"AUTOMOBILE": 1, "BUILDING": 2, "MACHINERY": 4}).alias("intervention_design_id"),
            (F.col("items") - 1).cast("int").alias("number_of_arms"),
            choose("c_mktsegment", {"BUILDING": 1, "FURNITURE": 3, "HOUSEHOLD": 5}).alias("masking_type_id"),
            choose("o_orderpriority", {"2-HIGH": 1, "5-LOW": 2}).alias("allocation_type_id"),
            F.lit(None).cast("string").alias("generated_study_design"),
        )

    def contact(self) -> DataFrame:
        # The id only orders the contacts of a trial: by line, part and supplier.
        return self.table("lineitem").select(
            F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.col("l_orderkey").alias("trial_id"),
            choose("l_returnflag", {"R": "scientific"}, "public", "string").alias("contact_type"),
            F.concat(F.lit("Line"), F.col("l_linenumber").cast("string")).alias("firstname"),
            F.lit(None).cast("string").alias("middlename"),
            F.concat(F.lit("Part|"), F.col("l_partkey").cast("string")).alias("lastname"),
            F.col("l_suppkey").cast("string").alias("telephone"),
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("@example.org")).alias("email"),
        )

    def criteria(self) -> DataFrame:
        return self.orders("items", "part").select(
            F.col("o_orderkey").alias("trial_id"),
            F.concat(F.lit("Uses "), "p_name").alias("inclusion_criteria"),
            F.lit("Not informed").alias("exclusion_criteria"),
            F.col("p_size").alias("age_min_value"),
            choose("p_type", {"ECONOMY": "Y", "LARGE": "M", "PROMO": "MIN"}, None, "string").alias("age_min_unit"),
            (F.col("items") - 1).cast("int").alias("age_max_value"),
            choose("p_type", {"SMALL": "W", "PROMO": "H", "LARGE": "D"}, None, "string").alias("age_max_unit"),
            choose("o_orderstatus", {"F": "female", "O": "male"}, "all", "string").alias("gender"),
        )

    def results(self) -> DataFrame:
        text = lambda name: F.lit(None).cast("string").alias(name)
        date = lambda name: F.lit(None).cast("date").alias(name)
        return self.items().select(
            F.col("o_orderkey").alias("trial_id"),
            F.col("quantity").cast("int").alias("actual_enrolment"),
            F.col("first_ship").alias("date_completed"),
            text("url_link"), text("summary"), date("date_posted"), date("date_first_publication"),
            text("baseline_char"), text("participant_flow"), text("adverse_events"),
            text("outcome_measures"), text("url_protocol"),
            F.when(F.col("items") > 4, F.lit("yes")).when(F.col("items") > 2, F.lit("no")).alias("ipd_plan"),
            F.concat(F.lit("Items: "), F.col("items").cast("string")).alias("ipd_description"),
        )

    def users(self) -> DataFrame:
        name = F.lower("c_name")
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            name.alias("username"),
            F.col("c_name").alias("full_name"),
            F.concat(name, F.lit("@example.org")).alias("email"),
            choose("c_mktsegment", {"AUTOMOBILE": 2, "BUILDING": 3, "FURNITURE": 4, "HOUSEHOLD": 2}).alias("role_id"),
            F.when(F.col("c_acctbal") < 0, F.lit("pending")).otherwise(F.lit("active")).alias("user_status"),
            F.date_add(F.lit("2001-01-01").cast("date"), F.col("c_nationkey")).cast("timestamp_ntz").alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("last_login_at"),
        )

    def requests(self) -> DataFrame:
        """Access requests; some suppliers ask for the name of an existing user."""
        name = F.when(F.col("s_acctbal") > 9000, F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")))).otherwise(
            F.lower("s_name")
        )
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.concat("s_name", F.lit("|x")).alias("full_name"),
            F.concat(name, F.lit("@example.org")).alias("email"),
            name.alias("requested_username"),
            F.when(F.col("s_nationkey") < 8, F.lit("registrant"))
            .when(F.col("s_nationkey") < 16, F.lit("reviewer"))
            .otherwise(F.lit("auditor")).alias("requested_role"),
            F.lit("access").alias("request_reason"),
            F.when(F.col("s_acctbal") < 0, F.lit("approved")).otherwise(F.lit("pending")).alias("request_status"),
            F.lit(None).cast("long").alias("reviewed_by"),
            F.lit(None).cast("timestamp_ntz").alias("reviewed_at"),
            F.lit(None).cast("string").alias("review_comment"),
            F.date_add(F.lit("2001-06-01").cast("date"), F.col("s_nationkey")).cast("timestamp_ntz").alias("created_at"),
        )

    def registry(self, *trial_columns: str, also: tuple[str, ...] = ()) -> Registry:
        """A registry whose trial table has just these columns, with these other tables."""
        derived = {
            "trial_study_design": self.study_design,
            "trial_contact": self.contact,
            "trial_criteria": self.criteria,
            "trial_results": self.results,
            "app_user": self.users,
            "app_user_request": self.requests,
        }
        tables = {name: derived[name]() for name in also}
        return new_registry(self.spark).replace({"trial": self.trial(*trial_columns), **tables})

    # --- inputs of the access batches ---------------------------------------------

    def new_requests(self) -> DataFrame:
        """A request per order; the orders of two customers share an e-mail address."""
        customer = F.col("o_custkey")
        return self.table("orders").select(
            (F.col("o_orderkey") + 1).alias("position"),
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit("  "))
            .otherwise(F.concat(F.lit("Customer "), customer.cast("string"))).alias("full_name"),
            F.concat(F.lit("M"), F.floor(customer / 2).cast("string"), F.lit("@x.org")).alias("email"),
            F.concat(F.lit(" u"), customer.cast("string"), F.lit(" ")).alias("requested_username"),
            choose("o_orderstatus", {"F": "Registrant", "O": " reviewer"}, "admin", "string").alias("requested_role"),
            F.lit(None).cast("string").alias("request_reason"),
        )

    def known_users(self) -> DataFrame:
        return self.table("customer").filter(F.col("c_acctbal") < 0).select(
            F.col("c_custkey").alias("id"),
            F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("username"),
            F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@y.org")).alias("email"),
        )

    def known_requests(self) -> DataFrame:
        key = F.col("s_suppkey").cast("string")
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.lit("S").alias("full_name"),
            F.concat(F.lit("m"), key, F.lit("@X.org")).alias("email"),
            F.concat(F.lit("supplier"), key).alias("requested_username"),
            F.lit("reviewer").alias("requested_role"),
            F.lit("").alias("request_reason"),
            F.when(F.col("s_acctbal") < 5000, F.lit("pending")).otherwise(F.lit("rejected")).alias("request_status"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
        )

    def open_requests(self) -> DataFrame:
        """A request per customer; two customers share an e-mail address."""
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("full_name"),
            F.concat(F.lit("m"), F.floor(F.col("c_custkey") / 2).cast("string"), F.lit("@x.org")).alias("email"),
            F.lower("c_name").alias("requested_username"),
            choose("c_mktsegment", {"BUILDING": "reviewer", "FURNITURE": "auditor"}, "registrant", "string").alias("requested_role"),
            F.lit("").alias("request_reason"),
            F.when(F.col("c_acctbal") < 0, F.lit("approved")).otherwise(F.lit("pending")).alias("request_status"),
            F.lit(None).cast("long").alias("reviewed_by"),
            F.lit(None).cast("timestamp_ntz").alias("reviewed_at"),
            F.lit(None).cast("string").alias("review_comment"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
        )

    def staff(self) -> DataFrame:
        """A user per supplier; some are admins, some carry a customer's user name."""
        rich = F.col("s_acctbal") > 5000
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.when(rich, F.replace("s_name", F.lit("Supplier"), F.lit("CUSTOMER"))).otherwise(F.col("s_name")).alias("username"),
            F.col("s_name").alias("full_name"),
            F.concat("s_name", F.lit("@y.org")).alias("email"),
            F.when(F.col("s_nationkey") < 16, F.lit(4)).otherwise(F.lit(2)).cast("long").alias("role_id"),
            F.when(F.col("s_acctbal") < 0, F.lit("pending")).otherwise(F.lit("active")).alias("user_status"),
        )

    def decisions(self) -> DataFrame:
        """A decision per order on the request of its customer, by one of four users or nobody."""
        return self.table("orders").select(
            (F.col("o_orderkey") + 1).alias("position"),
            F.col("o_custkey").alias("request_id"),
            choose("o_orderpriority", {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 4}).alias("admin_user_id"),
            choose("o_orderstatus", {"F": "no", "O": ""}, None, "string").alias("review_comment"),
        )

    # --- registry documents ----------------------------------------------------------

    def element_orders(self) -> DataFrame:
        """What elements are made of, a row per order. Staged: imports that follow each other share it,
        and the sort by order key, which reads its input twice, does not join twice."""
        if self._element_orders is None:
            self._element_orders = stage(
                self.orders("items", "names", "part", "customer", "region").select(
                    "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority",
                    "first_ship", "items", "quantity", "names", "p_name", "p_brand", "p_type",
                    "c_name", "c_mktsegment", "r_name",
                ),
                "element-orders",
            )
        return self._element_orders

    def trial_elements(self, statuses: tuple[str, ...] = ("F", "O", "P")) -> DataFrame:
        """A ``trial`` element per order with one of these statuses, in order of the order key, as XML text.

        The orders of one customer are versions of one trial. Orders without
        items have no trial id, and some break a length or a number rule.
        """
        key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
        main = F.struct(
            F.when(F.col("items").isNotNull(), F.concat(F.lit("RBR-C"), F.col("o_custkey").cast("string"))).alias("trial_id"),
            F.date_format("o_orderdate", "dd/MM/yyyy").alias("date_registration"),
            F.concat(F.lit(" "), "c_name", F.lit("  &  Co ")).alias("primary_sponsor"),
            F.concat(F.lit("Order\t"), key).alias("public_title"),
            F.date_format("first_ship", "yyyy-MM-dd").alias("date_enrolment"),
            choose("o_orderstatus", {"F": "Actual", "O": "anticipated"}, "actual", "string").alias("type_enrolment"),
            F.when(F.col("quantity") > 250, F.lit("99999999999")).otherwise(F.concat(F.lit("about "), F.col("quantity").cast("string"))).alias("target_size"),
            choose("o_orderpriority", {"1-URGENT": "recruiting", "2-HIGH": "Not yet recruiting", "3-MEDIUM": "On hold"}, None, "string").alias("recruitment_status"),
            choose("c_mktsegment", {"BUILDING": "Intervention", "MACHINERY": "expanded access"}, None, "string").alias("study_type"),
            F.when(status == "F", F.lit("n/a, randomized, Double-Blind, 2 arms")).when(status == "O", F.lit("open label")).alias("study_design"),
            choose("r_name", {"AFRICA": "N/A", "AMERICA": "Phase 1", "ASIA": "phase-1", "EUROPE": "Phase 9"}, None, "string").alias("phase"),
            F.col("names").alias("hc_freetext"),
        )
        repeated = lambda name, *values: F.struct(F.array(*values).alias(name))
        element = F.struct(
            main.alias("main"),
            F.struct(
                F.array(
                    F.struct(
                        F.lit("public").alias("type"), F.col("c_name").alias("firstname"),
                        F.when(F.col("c_mktsegment") == "FURNITURE", F.when(status == "P", F.lit("Brazil"))).alias("country1"),
                    )
                ).alias("contact")
            ).alias("contacts"),
            repeated("country2", F.lit("Brazil"), F.lit("BR"), F.col("r_name")).alias("countries"),
            F.when(status != "P", F.struct(F.lit("18Y").alias("agemin"), F.lit("F").alias("gender"))).alias("criteria"),
            repeated("prim_outcome", F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("primary_outcome"),
            repeated("hc_keyword", F.col("p_type")).alias("health_condition_keyword"),
        )
        return self.element_orders().filter(status.isin(*statuses)).orderBy("o_orderkey").select(
            F.to_xml(element, {"rowTag": "trial"}).alias("element")
        )
