"""The cohort calculation of one model, a state and a period at a time."""

from cohortspan.tables import PAYMENT_DEFAULTS


def terms_of(plans, present):
    """Plan name -> terms: absent columns have defaults, blank cells are 0."""
    return {
        row["payment"]: {
            c: (row.get(c) or 0.0) if c in present else default
            for c, default in PAYMENT_DEFAULTS.items()
        }
        for row in plans
    }


def expand(knots):
    """(p_prog, QoL, p_death, plan) of states 1..n."""
    knots = sorted(knots)
    first, states = knots[0][0], []
    for j, (at, prog, _, death, payment) in enumerate(knots):
        after = knots[j + 1] if j + 1 < len(knots) else None
        target = (after[2] or 0.0) if after else 0.0
        start = [k for k in knots if k[2] is not None and k[0] <= at][-1]
        later = [k[0] for k in knots if k[2] is not None and k[0] > at]
        end = later[0] if later else knots[-1][0] + 1
        for n in range(at, after[0] if after else at + 1):
            quality = start[2] - (start[2] - target) * (n - start[0]) / (end - start[0])
            assert len(states) == n - first
            states.append((prog, quality, death, payment))
    return states


def project(states, horizon):
    n = len(states)
    shares = [[1.0] + [0.0] * (n - 1)]
    while len(shares) < horizon:
        old, new = shares[-1], [0.0] * n
        new[-1] += old[-1]
        for i, (prog, _, death, _) in enumerate(states[:-1]):
            new[i] += old[i] * (1 - prog) * (1 - death)
            new[i + 1] += old[i] * prog * (1 - death)
            new[-1] += old[i] * death
        shares.append(new)
    return shares


def pay(plan, time, start, discount, firm):
    if plan["tot_payment"] > 0:
        at = time - start + 1
        if not 1 <= at <= plan["contract_length"]:
            return 0.0
        grown = ((1 + firm) / (1 + discount)) ** (time - 1)
        first, length = plan["initial_payment"], plan["contract_length"]
        if first > 0:
            part = first if at == 1 else (1 - first) / max(length - 1, 1)
        else:
            part = 1 / max(length, 1)
        return plan["tot_payment"] * part * grown
    return plan["cont_payment"] * ((1 + plan["cost_trend"]) * (1 + discount)) ** -(time - 1)


def spans_of(chains):
    """Plan -> first and last state over the whole model."""
    spans = {}
    for states in chains.values():
        for number, (*_, payment) in enumerate(states, start=1):
            low, high = spans.get(payment, (number, number))
            spans[payment] = (min(low, number), max(high, number))
    return spans


def series(model):
    """(treatment, line) -> values by period; lines are plans, ``Refund`` and ``QALY``."""
    rows, plans, present, record = model
    horizon = int(record["time_horizon"])
    discount, firm = record["discount"], record["firm_discount"]
    terms = terms_of(plans, present)
    chains = {}
    for name, *knot in rows:
        chains.setdefault(name, []).append(tuple(knot))
    chains = {name: expand(knots) for name, knots in chains.items()}
    spans, found = spans_of(chains), {}
    for name, states in chains.items():
        shares = project(states, horizon)
        used = {s[3] for s in states if s[3] is not None}
        amount = {
            p: [pay(terms[p], t, spans[p][0], discount, firm) for t in range(1, horizon + 1)]
            for p in used
        }
        total = [p for p in used if terms[p]["tot_payment"] > 0]
        assert len(total) <= 1
        own = terms[total[0]] if total else None
        low, high = spans[total[0]] if total else (0, -1)
        stopped = [False] * horizon
        if own and own["aggregate_failure"] > 0:
            entered = shares[low - 1][low - 1]
            stopped = [entered - sum(x[low - 1 : high]) > own["aggregate_failure"] for x in shares]

        def due(t, payment, inside):
            """What a plan gets in period t (0-based), for states in or out of the total's span."""
            part = sum(
                x
                for i, x in enumerate(shares[t], start=1)
                if states[i - 1][3] == payment and (low <= i <= high) == inside
            )
            return part * amount[payment][t]

        for p in used:
            found[name, p] = [
                due(t, p, False) + (0 if stopped[t] else due(t, p, True)) for t in range(horizon)
            ]
        if own and own["refund"] > 0:
            if own["aggregate_failure"] > 0:
                paid = sum(due(t, p, True) for t in range(horizon) if not stopped[t] for p in used)
                back = [
                    paid * own["refund"] if t and stopped[t] != stopped[t - 1] else 0.0
                    for t in range(horizon)
                ]
            else:
                prog, _, death, _ = states[high - 1]
                leaving = prog * (1 - death) + (death if high + 1 == len(states) else 0)
                length = own["contract_length"]
                back = [
                    shares[t][high - 1] * leaving * own["refund"] * sum(amount[total[0]][:t])
                    if t and (t + 1 <= length or length >= horizon)
                    else 0.0
                    for t in range(horizon)
                ]
            found[name, "Refund"] = [-b for b in back]
        found[name, "QALY"] = [
            sum(x * s[1] for x, s in zip(shares[t], states)) * (1 + discount) ** -t
            for t in range(horizon)
        ]
    return found


def incremental(model):
    """``active - control`` -> QALY, cost and their ratio."""
    found = series(model)
    names = sorted({name for name, _ in found})
    controls = names[len(names) - int(model[3]["control_count"]) :]
    health = {n: sum(found[n, "QALY"]) for n in names}
    cost = {n: sum(sum(v) for (m, line), v in found.items() if m == n and line != "QALY") for n in names}
    pairs = [(a, c) for a in names if a not in controls for c in controls]
    made = {}
    for a, c in pairs:
        gain, price = health[a] - health[c], cost[a] - cost[c]
        made[f"{a} - {c}"] = (gain, price, price / gain)
    return made
