"""What the operators of an executed plan made."""


def joined_rows(plan) -> int:
    """Rows that all joins of an executed plan made."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return joined_rows(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return joined_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return own + sum(joined_rows(plan.children().apply(k)) for k in range(plan.children().size()))
