"""Executed plans, node by node: what was scanned and how many rows were shuffled."""


def _seq(scala):
    return [scala.apply(i) for i in range(scala.size())]


def nodes(plan):
    """(name, node) of every node of a physical plan that ran, scalar subqueries included, reused parts once."""
    name = plan.getClass().getSimpleName()
    yield name, plan
    if name in ("ReusedExchangeExec", "ReusedSubqueryExec"):
        return
    if name == "AdaptiveSparkPlanExec":
        inner = [plan.executedPlan()]
    elif name.endswith("QueryStageExec"):
        inner = [plan.plan()]
    else:
        inner = _seq(plan.children())
    for child in [*inner, *_seq(plan.subqueries())]:
        yield from nodes(child)


def executed(df):
    """All nodes of a frame's plan, after computing it in full."""
    df.collect()
    return list(nodes(df._jdf.queryExecution().executedPlan()))


def metric(node, name: str) -> int:
    found = node.metrics().get(name)
    return found.get().value() if found.isDefined() else 0


def shuffled_rows(found) -> list[int]:
    """Rows that each exchange wrote, the largest first."""
    return sorted((metric(node, "shuffleRecordsWritten") for name, node in found if name == "ShuffleExchangeExec"), reverse=True)


def scans(found) -> int:
    return sum(name == "FileSourceScanExec" for name, _ in found)


def scanned_rows(found) -> list[int]:
    return sorted((metric(node, "numOutputRows") for name, node in found if name == "FileSourceScanExec"), reverse=True)
