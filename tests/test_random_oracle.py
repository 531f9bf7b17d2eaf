"""Random small contact tables: Spark stages == DuckDB oracle chain on the same rows.

Small value domains force ties on time, repeated phones across slots and
sources, '0' slots, null clients/periods/phones and clients contacted from
both attempt tables.
"""

import datetime as dt
import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from fonolytics.config import ProfileConfig
from fonolytics.plans import oracle as o
from fonolytics.plans.stages import ContactStages
from fonolytics.sources.tables import ATTEMPT_SCHEMA, OUTCOME_SCHEMA, ContactTables, assignment_schema

CFG = ProfileConfig(periods=("202601", "202602", "202603", "202604"), labels=("enero", "febrero", "marzo", "abril"),
                    backup_min_period=202602, n_phones=4)
CODES = [("CE", "contacto - efectivo"), ("PDP", "pdp"), ("FDP", "pdp - fdp"), ("NC", "no contacto"), ("CE", "contacto - efectivo")]


def _attempts(rng, n):
    cu = rng.integers(0, 12, n).astype(object)
    cu[rng.random(n) < 0.05] = None
    per = rng.choice(["202512", "202601", "202602", "202603", "202604", "x"], n).astype(object)
    per[rng.random(n) < 0.03] = None
    return pd.DataFrame({
        "periodo": per,
        "contact_id": pd.array(cu, dtype="Int64"),
        "wrap_up": rng.choice(["CE", "PDP", "FDP", "NC", None], n),
        "dnis": [None if rng.random() < 0.05 else f"51{900000000 + int(rng.integers(0, 6))}" for _ in range(n)],
        "fecha_key": [dt.datetime(2026, 1, 1) + dt.timedelta(hours=int(h)) for h in rng.integers(0, 6, n)],
        "id_intento": pd.array(rng.integers(0, 4, n), dtype="Int64"),
        "campaign_name": rng.choice(["cob_bpe_00", "cob_bpe_02", "otra"], n),
    })


def _assignment(rng, n, string_phones=False):
    cu = rng.integers(0, 12, n).astype(object)
    cu[rng.random(n) < 0.05] = None
    d = {
        "codunicocli": pd.array(cu, dtype="Int64"),
        "codmes": rng.choice(["202601", "202602", "202603", "202604", "202605"], n),
        "tramo_asignacion": rng.choice(["temprana", "intermedia", "tardia", "judicial"], n),
        "id_asignacion": pd.array(rng.permutation(n), dtype="Int64"),
        "saldo": rng.random(n).round(2),
    }
    for k in range(1, 5):
        if string_phones:
            pool = ["0", "", "00", "900000001", "0900000002", "900000003", "900000004", None]
            d[f"telefono{k}"] = [pool[i] for i in rng.integers(0, len(pool), n)]
        else:
            d[f"telefono{k}"] = pd.array(rng.choice([0, 900000000, 900000001, 900000002, 900000003, 900000004, 900000005], n),
                                         dtype="Int64")
    return pd.DataFrame(d)


def _py(df):
    def conv(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return None
        if isinstance(v, np.integer):
            return int(v)
        if isinstance(v, np.floating):
            return float(v)
        if isinstance(v, pd.Timestamp):
            return v.to_pydatetime()
        return v

    return [tuple(conv(v) for v in row) for row in df.itertuples(index=False)]


def _bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: "<null>" if v is None or (isinstance(v, float) and np.isnan(v)) else str(v)
    return sorted(hashlib.md5("|".join(norm(r[i]) for i in order).encode()).hexdigest() for r in rows)


STAGES = {
    "d2": lambda p: p.d2_live.select("mes", "cu", "wrap_up", "telefono"),
    "d3": lambda p: p.d3_backup.select("mes", "cu", "wrap_up", "telefono"),
    "d4": lambda p: p.d4_effective_attempts.select("fuente", "mes", "cu", "wrap_up", "telefono", "orden"),
    "d5": lambda p: p.d5_first_contacts,
    "d12": lambda p: p.d12_profile,
    "d17": lambda p: p.d17_alerts(ordered=False),
    "d18": lambda p: p.d18_summary(ordered=False),
    "d22": lambda p: p.d22_profile_alerts,
}


@pytest.mark.parametrize("seed,string_phones", [(1, False), (2, False), (3, False), (4, False), (5, True), (6, True)])
def test_random_tables_match_oracle(spark, seed, string_phones):
    rng = np.random.default_rng(seed)
    live, bkp, asig = _attempts(rng, 120), _attempts(rng, 80), _assignment(rng, 40, string_phones)
    outcomes = pd.DataFrame(CODES, columns=["conlusion_cloud", "tipo_resultado"])
    con = duckdb.connect()
    for name, df in (("intentos", live), ("intentos_bkp", bkp), ("asignacion", asig), ("conclusiones", outcomes)):
        con.register(f"{name}_df", df)
        con.execute(f"create view {name} as select * from {name}_df")
    t = ContactTables(
        intentos=spark.createDataFrame(_py(live), ATTEMPT_SCHEMA),
        intentos_bkp=spark.createDataFrame(_py(bkp), ATTEMPT_SCHEMA),
        conclusiones=spark.createDataFrame(_py(outcomes), OUTCOME_SCHEMA),
        asignacion=spark.createDataFrame(_py(asig), assignment_schema(4, T.StringType() if string_phones else T.LongType())),
    )
    p = ContactStages(t, CFG)
    chain = o.stage_ctes(CFG) + list(o.final_selects(CFG).items())
    finals = {"d2": "select mes, cu, wrap_up, telefono from d2", "d3": "select mes, cu, wrap_up, telefono from d3",
              "d4": "select fuente, mes, cu, wrap_up, telefono, orden from d4",
              "d5": "select fuente, mes, cu, wrap_up, telefono, orden from d5", "d12": "select * from d12",
              "d17": "select * from d17", "d18": "select * from d18", "d22": o.d22_select(CFG)}
    sizes = {}
    for key, get in STAGES.items():
        df = get(p)
        s_rows = [tuple(r) for r in df.collect()]
        rel = con.sql(o.with_chain(chain, finals[key]))
        d_rows = rel.fetchall()
        assert sorted(df.columns) == sorted(rel.columns), key
        assert _bag(s_rows, df.columns) == _bag(d_rows, rel.columns), (seed, key, len(s_rows), len(d_rows))
        sizes[key] = len(s_rows)
    # R6 (phone re-scoring) over the same random tables
    from fonolytics.plans.jobs import _sql_phone_rescore, rescore_for

    rs = rescore_for(p, CFG)
    rel = con.sql(_sql_phone_rescore(CFG, with_fixture=False))
    assert sorted(rs.columns) == sorted(rel.columns)
    assert _bag([tuple(r) for r in rs.collect()], rs.columns) == _bag(rel.fetchall(), rel.columns), (seed, "r6")
    # the random tables must exercise the stages, not agree on empty results
    assert sizes["d12"] > 0 and sizes["d17"] > 0 and sizes["d5"] > 10
