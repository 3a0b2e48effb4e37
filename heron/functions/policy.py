"""Layered settings and access plans, as Column expressions over maps of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from heron.functions.urls import STRATEGIES, mapped

#: What a plan is where no layer says otherwise.
ATTEMPTS, ESCALATIONS, DELAY = 3, 3, 3.0
EMPTY = "cast(map() as map<string,string>)"


def merged(*layers: Column) -> Column:
    """One map of all layers, weakest first: the strongest value that isn't null stays."""
    filled = [F.coalesce(x, F.expr(EMPTY)) for x in layers]
    return F.map_filter(reduce(lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x)), filled), lambda _, v: v.isNotNull())


def _true(c: Column) -> Column:
    return F.lower(c) == "true"


def access_plan(playbook: Column, spec: Column, recon: Column, overrides: Column) -> Column:
    """Struct of the plan: overrides before the fetch spec before the playbook; what a probe saw counts only where the strategy is still the weakest.

    Each layer is a map of text to text; a null or empty map says nothing.
    """
    book, asked, seen, over = (lambda k, m=m: F.try_element_at(F.coalesce(m, F.expr(EMPTY)), F.lit(k)) for m in (playbook, spec, recon, overrides))
    said = lambda c: F.when(c != "", mapped(c, STRATEGIES, "requests"))
    yes = lambda c: F.coalesce(_true(c), F.lit(False))
    manual = F.coalesce(book("strategy") == "manual", F.lit(False))
    named = F.coalesce(said(asked("method")), said(book("strategy")), F.lit("requests"))
    fenced = yes(seen("challenge_detected")) | F.coalesce(seen("waf") != "", F.lit(False)) | yes(seen("waf_detected"))
    probed = F.when(named == "requests", F.when(fenced, "stealth").when(yes(seen("js_required")), "js").otherwise(named)).otherwise(named)
    patient = F.coalesce(_true(asked("patient_on_block")), yes(book("patient")) | yes(asked("patient")) | yes(asked("slow_drip"))) | ((named == "requests") & fenced)
    return F.struct(
        F.coalesce(over("initial_strategy"), probed).alias("initial_strategy"),
        F.coalesce(over("access_max_attempts").try_cast("int"), book("max_attempts").try_cast("int"), F.lit(ATTEMPTS)).alias("max_attempts"),
        F.when(over("access_escalation_mode") == "static", 0).otherwise(ESCALATIONS).alias("max_escalations"),
        patient.alias("patient_mode"),
        F.coalesce(asked("delay").try_cast("double"), book("delay").try_cast("double"), F.lit(DELAY)).alias("delay_seconds"),
        F.coalesce(_true(asked("allow_stealth")), F.lit(True)).alias("allow_stealth"),
        F.coalesce(_true(asked("allow_visible")), manual).alias("allow_visible"),
    )
