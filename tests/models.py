"""Small models made for these tests; what they give is calculated in tests/brute.py."""

from cohortspan.tables import (
    GLOBAL_FIELDS,
    PAYMENT_COLUMNS,
    PAYMENT_FIELDS,
    STATE_FIELDS,
    ModelBundle,
    fields_frame,
)


def plan(payment, **terms):
    return {"payment": payment, **terms}


def rates(discount, firm, horizon, controls=1):
    return {
        "discount": discount,
        "firm_discount": firm,
        "time_horizon": float(horizon),
        "control_count": float(controls),
    }


# name -> (states, plans, columns present in the plan table, globals)
MODELS = {
    # The one model whose published ratio, 1.09, is asserted.
    "anchor": (
        [
            ("Active", 1, 0.05, 1.0, 0.01, "once"),
            ("Active", 2, 1.0, 0.67, 0.02, "ongoing"),
            ("Active", 3, 1.0, 0.33, 0.02, "ongoing"),
            ("Active", 4, 0.0, 0.0, 0.0, None),
            ("Comparison", 1, 1.0, 1.0, 0.01, "ongoing"),
            ("Comparison", 2, 1.0, 0.67, 0.02, "ongoing"),
            ("Comparison", 3, 1.0, 0.33, 0.02, "ongoing"),
            ("Comparison", 4, 0.0, 0.0, 0.0, None),
        ],
        [
            plan("once", tot_payment=15.0, cont_payment=0.0, contract_length=10.0),
            plan("ongoing", tot_payment=0.0, cont_payment=0.1),
        ],
        ["tot_payment", "cont_payment", "contract_length"],
        rates(0.0, 0.0, 20),
    ),
    # Gaps between states, a blank quality, a refund to individuals.
    "gaps": (
        [
            ("gene", 1, 0.07, 0.95, 0.015, "outright"),
            ("gene", 2, 0.6, None, 0.03, "upkeep"),
            ("gene", 5, 1.0, 0.4, 0.05, "upkeep"),
            ("gene", 6, 0.0, 0.0, 0.0, None),
            ("usual", 1, 0.8, 0.9, 0.02, "upkeep"),
            ("usual", 3, 0.5, 0.45, 0.04, "upkeep"),
            ("usual", 6, 0.0, 0.0, 0.0, None),
        ],
        [
            plan("outright", tot_payment=12.0, contract_length=6.0, initial_payment=0.4, refund=0.75),
            plan("upkeep", cont_payment=0.25),
        ],
        ["tot_payment", "cont_payment", "contract_length", "initial_payment", "refund"],
        rates(0.02, 0.05, 15),
    ),
    # A stop rule that turns while instalments run; two plans span the same states.
    "halting": (
        [
            ("gene", 1, 0.2, 1.0, 0.02, "bounded"),
            ("gene", 2, 0.5, 0.6, 0.02, "upkeep"),
            ("gene", 3, 0.0, 0.0, 0.0, None),
            ("usual", 1, 0.6, 0.8, 0.03, "upkeep"),
            ("usual", 2, 0.4, 0.5, 0.05, "upkeep"),
            ("usual", 3, 0.0, 0.0, 0.0, None),
        ],
        [
            plan(
                "bounded",
                tot_payment=9.0,
                cont_payment=0.0,
                contract_length=8.0,
                initial_payment=0.25,
                refund=0.6,
                aggregate_failure=0.35,
            ),
            plan("upkeep", tot_payment=0.0, cont_payment=0.3),
        ],
        list(PAYMENT_COLUMNS)[1:],
        rates(0.04, 0.01, 18),
    ),
    # A plan with a total that starts at state 2, under a stop rule.
    "late": (
        [
            ("gene", 1, 0.9, 0.9, 0.01, "upkeep"),
            ("gene", 2, 0.1, 0.85, 0.01, "delayed"),
            ("gene", 3, 0.7, 0.5, 0.03, "upkeep"),
            ("gene", 4, 0.0, 0.0, 0.0, None),
            ("usual", 1, 0.5, 0.9, 0.02, "upkeep"),
            ("usual", 4, 0.0, 0.0, 0.0, None),
        ],
        [
            plan("delayed", tot_payment=6.0, contract_length=3.0, refund=0.5, aggregate_failure=0.2),
            plan("upkeep", cont_payment=0.2),
        ],
        ["tot_payment", "cont_payment", "contract_length", "refund", "aggregate_failure"],
        rates(0.03, 0.02, 12),
    ),
    # Several active arms and two controls; a continuous payment that falls.
    "crowd": (
        [
            ("alpha", 1, 0.1, 0.9, 0.02, "three"),
            ("alpha", 2, 0.3, 0.5, 0.05, "falling"),
            ("alpha", 3, 0.0, 0.0, 0.0, None),
            ("beta", 1, 0.0, 0.8, 0.01, "seven"),
            ("beta", 2, 0.0, 0.0, 0.0, None),
            ("gamma", 1, 0.45, 0.85, 0.04, "falling"),
            ("gamma", 4, 0.0, 0.0, 0.0, None),
            ("zeta", 1, 0.7, 0.7, 0.1, "falling"),
            ("zeta", 2, 0.0, 0.0, 0.0, None),
        ],
        [
            plan("three", tot_payment=4.0, cont_payment=0.0, contract_length=3.0),
            plan("seven", tot_payment=5.0, cont_payment=0.0, contract_length=7.0),
            plan("falling", tot_payment=0.0, cont_payment=0.4, cost_trend=0.06),
        ],
        ["tot_payment", "cont_payment", "contract_length", "cost_trend"],
        rates(0.05, 0.0, 9, 2),
    ),
    # Values outside their limits.
    "faulty": (
        [
            ("gene", 1, -0.1, -2.0, 0.01, "outright"),
            ("gene", 2, 1.0, None, 0.02, "upkeep"),
            ("gene", 4, 0.0, 0.0, 0.0, None),
            ("usual", 1, 1.0, 1.0, -0.3, "upkeep"),
            ("usual", 3, 0.0, 0.0, 1.5, None),
        ],
        [
            plan("outright", tot_payment=3.0, cont_payment=0.0, contract_length=250.0),
            plan("upkeep", tot_payment=0.0, cont_payment=0.5),
        ],
        ["tot_payment", "cont_payment", "contract_length"],
        rates(0.0, 0.0, 20),
    ),
}

PLAN_NUMBERS = [c for c in PAYMENT_COLUMNS if c != "payment"]


def bundle_of(spark, names):
    """All the named models in one bundle; ``scenario_id`` is the model's name."""
    states, plans, values = [], [], []
    for name in names:
        model_states, model_plans, present, record = MODELS[name]
        for at, row in enumerate(model_states, start=1):
            states.append((name, at, *row))
        for at, row in enumerate(model_plans, start=1):
            terms = [row.get(c) for c in PLAN_NUMBERS]
            plans.append((name, at, row["payment"], *terms, present))
        values += [(name, k, v) for k, v in record.items()]
    state_type = (
        "scenario_id string, row_id long, treatment string, state int, p_prog double, "
        "QoL double, p_death double, payment string"
    )
    plan_type = (
        "scenario_id string, row_id long, payment string, "
        + ", ".join(f"{c} double" for c in PLAN_NUMBERS)
        + ", present_columns array<string>"
    )
    return ModelBundle(
        states=spark.createDataFrame(states, state_type),
        payments=spark.createDataFrame(plans, plan_type),
        globals=spark.createDataFrame(values, "scenario_id string, name string, value double"),
        state_fields=fields_frame(spark, STATE_FIELDS),
        payment_fields=fields_frame(spark, PAYMENT_FIELDS),
        global_fields=fields_frame(spark, GLOBAL_FIELDS),
    )
