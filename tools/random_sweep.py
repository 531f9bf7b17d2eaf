"""Every contact stage against the oracle chain on many random small tables.

    python tools/random_sweep.py [first_seed] [n_seeds]

The tables come from tests/test_random_oracle.py (ties, nulls, '0' and string
slots, both sources, a repeated outcome code). Prints the stages that differ.
"""
import os, sys
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT); sys.path.insert(0, os.path.join(ROOT, "tests"))
import numpy as np, duckdb, tempfile, pandas as pd
from pyspark.sql import types as T
import test_random_oracle as R
from fonolytics.session import local_session
from fonolytics.plans.materialize import ensure_checkpoint_dir
from fonolytics.plans import oracle as o
from fonolytics.plans.stages import ContactStages
from fonolytics.plans.catalog import ATTEMPT_COLS, RANKED_COLS
from fonolytics.sources.tables import ATTEMPT_SCHEMA, OUTCOME_SCHEMA, ContactTables, assignment_schema
spark=local_session(8,8)
ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix='fono-sweep-'))
cfg=R.CFG
getters = {
 "effective_outcomes": lambda p: p.d1_effective_outcomes,
 "effective_attempts_live": lambda p: p.d2_live.select(*ATTEMPT_COLS),
 "effective_attempts_backup": lambda p: p.d3_backup.select(*ATTEMPT_COLS),
 "effective_attempts": lambda p: p.d4_effective_attempts.select(*RANKED_COLS),
 "first_contact_per_period": lambda p: p.d5_first_contacts,
 "assignment_snapshot": lambda p: p.d6_snapshot,
 "presence_matrix": lambda p: p.d7_presence,
 "contact_matrix": lambda p: p.d8_contacts,
 "target_period_contact": lambda p: p.d9_target_contact,
 "clean_phones": lambda p: p.d10_clean_phones,
 "month_status": lambda p: p.d11_month_status,
 "client_profile": lambda p: p.d12_profile,
 "contact_phones_long": lambda p: p.d13_contact_phones,
 "assigned_phones_long": lambda p: p.d14_assigned_phones,
 "alerts_priority": lambda p: p.d15_priority,
 "alerts_dead_phones": lambda p: p.d16_dead,
 "phone_alerts": lambda p: p.d17_alerts(ordered=False),
 "alert_summary": lambda p: p.d18_summary(ordered=False),
 "a1_positions": lambda p: p.d19_a1,
 "a2_clients": lambda p: p.d20_a2,
 "a3_positions": lambda p: p.d21_a3,
 "client_profile_alerts": lambda p: p.d22_profile_alerts,
}
chain = o.stage_ctes(cfg) + list(o.final_selects(cfg).items())
clean = ", ".join(f"case when cast(telefono{k} as varchar) = '0' then null else telefono{k} end as tlf{k}_limpio" for k in range(1, cfg.n_phones+1))
cells = ", ".join([f"case when p.pres_{l} = 1 then coalesce(h.{l}_res, 'nc') end as {l}" for l in cfg.labels] + [f"case when p.pres_{l} = 1 then h.{l}_tlf end as {l}_tlf" for l in cfg.labels])
finals = dict(o.STAGE_FINALS)
finals.update({"clean_phones": f"select *, {clean} from d6", "month_status": f"select p.cu, {cells} from d7 p left join d8 h on p.cu = h.cu",
  "alert_summary": "select * from d18", "a1_positions": "select * from d19", "a2_clients": "select * from d20", "a3_positions": "select * from d21",
  "client_profile_alerts": o.d22_select(cfg), "phone_alerts": "select * from d17"})
bad=[]
first = int(sys.argv[1]) if len(sys.argv) > 1 else 200
count = int(sys.argv[2]) if len(sys.argv) > 2 else 30
for seed in range(first, first + count):
    rng=np.random.default_rng(seed); sp=bool(seed%2)
    live, bkp, asig = R._attempts(rng, int(rng.integers(20, 300))), R._attempts(rng, int(rng.integers(1, 200))), R._assignment(rng, int(rng.integers(5, 80)), sp)
    outcomes = pd.DataFrame(R.CODES, columns=["conlusion_cloud","tipo_resultado"])
    con=duckdb.connect()
    for name, df in (("intentos", live), ("intentos_bkp", bkp), ("asignacion", asig), ("conclusiones", outcomes)):
        con.register(f"{name}_df", df); con.execute(f"create view {name} as select * from {name}_df")
    t=ContactTables(spark.createDataFrame(R._py(live), ATTEMPT_SCHEMA), spark.createDataFrame(R._py(bkp), ATTEMPT_SCHEMA),
                    spark.createDataFrame(R._py(outcomes), OUTCOME_SCHEMA),
                    spark.createDataFrame(R._py(asig), assignment_schema(4, T.StringType() if sp else T.LongType())))
    p=ContactStages(t, cfg)
    for k, get in getters.items():
        df=get(p); rel=con.sql(o.with_chain(chain, finals[k]))
        if sorted(df.columns)!=sorted(rel.columns) or R._bag([tuple(r) for r in df.collect()], df.columns)!=R._bag(rel.fetchall(), rel.columns):
            bad.append((seed,k))
    print(seed, [b[1] for b in bad if b[0]==seed] or "ok", flush=True)
print("BAD", bad)
