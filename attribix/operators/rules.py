"""Decision tables over semi-structured observations, as ordered ``when`` chains.

Every table returns a struct that names the rule that fired, so a decision can
be traced from the output alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attribix.functions.derive import is_arm_token, token
from attribix.functions.numeric import col

# Token lists and labels of the observation vocabulary.
DRIVE_SHOTS = ["DRIVE", "LAYUP", "FLOATER"]
ASCENT = ["ASCENT", "RISING", "GOING_UP", "BEFORE_APEX", "BEFORE_RELEASE", "DURING_SHOT_MOTION", "AT_RELEASE", "AT_APEX"]
DESCENT = [
    "DESCENT", "FALLING", "DESCENDING", "LANDING", "AFTER_APEX", "AFTER_RELEASE", "AFTER_RELEASE_DESCENDING", "AT_LANDING",
]
LABELS = ["YES", "NO", "UNCLEAR"]
OFF_ZONE_FEET = ["NEAR_BUT_NOT_UNDER", "AWAY_FROM_LANDING"]
EARLY_CONTACT = ["BEFORE_RELEASE", "AT_RELEASE"]
DESCENT_CONTACT = "DURING_DESCENT_OR_LANDING"
SHORT_FIELDS = ["who_initiated", "ball_state_at_contact", "arm_geometry"]
LONG_FIELDS = [
    "contact_initiator", "arm_direction_at_contact", "ball_location_at_contact", "shooter_body_state",
    "shooter_initiates_contact", "hook_or_bar_arm", "both_hands_on_vertical_arc", "rising_without_release",
]
TRIGGER_FIELDS = [
    "shooter_initiates_contact", "hook_or_bar_arm", "both_hands_on_vertical_arc", "rising_without_release",
    "contact_initiator", "arm_direction_at_contact",
]
TIMINGS = {"BEFORE": "PRE_COMMIT", "DURING": "IN_ACT", "AFTER": "IN_ACT"}
GATES = ((0.85, 0.70, "PASS"), (0.70, None, "PROMISING"), (0.55, None, "MARGINAL"))

CONTACT = "struct<order: int, shooter_motion: string, defender_body_part: string, shooter_body_part: string, description: string>"
DESCRIBE_SCHEMA = f"shot_type string, narrative string, contacts array<{CONTACT}>, primary_foul_contact_index string"
OBSERVE_SCHEMA = """shot_type string, shooter_airborne string, who_initiated string, primary_contact_body_part string,
  defender_feet_at_shooter_landing string, contact_timing string"""
SPATIAL_SCHEMA = """landing_foul string, shot_type string, defender_position_at_landing string, contact_moment string,
  contact_vs_descent string, defender_in_landing_zone string, whistle_timing string, called_contact string,
  who_initiated_contact string, confidence string"""
PHASE_SCHEMA = """phase string, timing string, who_initiated string, ball_state_at_contact string, arm_geometry string,
  contact_initiator string, arm_direction_at_contact string, ball_location_at_contact string, shooter_body_state string,
  shooter_initiates_contact boolean, hook_or_bar_arm boolean, both_hands_on_vertical_arc boolean,
  rising_without_release boolean, gather_complete_at_contact boolean, could_still_abort boolean,
  ball_released_before_contact boolean"""

Rule = tuple[Column, str, str, str]


def decide(rules: Sequence[Rule], default: tuple[str, str, str]) -> Column:
    """First rule whose condition holds; a null condition does not hold."""
    def outcome(label: str, confidence: str, rule: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))

    chain = None
    for condition, *rest in rules:
        chain = F.when(condition, outcome(*rest)) if chain is None else chain.when(condition, outcome(*rest))
    return chain.otherwise(outcome(*default))


def upper(c: str | Column, trim: bool = True) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return F.upper(F.trim(text) if trim else text)


def primary_contact(contacts: str | Column, index: str | Column) -> Column:
    """The contact named by ``index``: unreadable counts as 0, out of range as the last; null without contacts."""
    items = col(contacts)
    wanted = F.coalesce(F.trim(col(index)).try_cast("int"), F.lit(0))
    inside = (wanted >= 0) & (wanted < F.size(items))
    return F.when(F.size(items) > 0, F.try_element_at(items, F.when(inside, wanted + 1).otherwise(F.lit(-1))))


def add_describe_decision(df: DataFrame, obs: str = "obs", name: str = "decision") -> DataFrame:
    """Label from a described contact sequence: body contact on descent counts, arm contact never does.

    The contact and its tokens are columns of their own, so that no rule
    evaluates them again.
    """
    contact = primary_contact(f"{obs}.contacts", f"{obs}.primary_foul_contact_index")
    staged = df.withColumns({"__contact": contact, "__shot": token(f"{obs}.shot_type")})
    # An object without any field is no contact.
    filled = [F.col(f"__contact.{n}").cast("string") for n in ("order", "shooter_motion", "defender_body_part", "shooter_body_part", "description")]
    staged = staged.withColumn("__none", F.coalesce(*filled).isNull())
    staged = staged.withColumns(
        {"__motion": token("__contact.shooter_motion"), "__arm": is_arm_token("__contact.defender_body_part")}
    )
    decision = decide(
        [
            (F.col("__shot").isin(DRIVE_SHOTS), "NO", "HIGH", "drive"),
            (F.col("__none"), "UNCLEAR", "LOW", "no_contacts"),
            (F.col("__motion").isin(ASCENT), "NO", "HIGH", "ascent_contact"),
            (F.col("__arm"), "NO", "HIGH", "arm_contact"),
            (F.col("__motion").isin(DESCENT), "YES", "HIGH", "descent_body_contact"),
            (F.col("__motion") == "ON_GROUND", "NO", "MEDIUM", "on_ground"),
        ],
        ("UNCLEAR", "LOW", "unclear"),
    )
    return staged.withColumn(name, decision).drop("__contact", "__none", "__shot", "__motion", "__arm")


def observe_decision(obs: str = "obs") -> Column:
    """Label from six observed features."""
    shot, air, who = upper(f"{obs}.shot_type"), upper(f"{obs}.shooter_airborne"), upper(f"{obs}.who_initiated")
    body, feet = upper(f"{obs}.primary_contact_body_part"), upper(f"{obs}.defender_feet_at_shooter_landing")
    timing = upper(f"{obs}.contact_timing")
    return decide(
        [
            ((shot == "DRIVE") | (air == "NO"), "NO", "MEDIUM", "not_airborne"),
            (who == "SHOOTER", "NO", "MEDIUM", "shooter_initiated"),
            (body == "ARM_OR_HAND", "NO", "MEDIUM", "arm_contact"),
            ((feet == "DIRECTLY_UNDER") & (who == "DEFENDER") & (air == "YES"), "YES", "MEDIUM", "feet_under"),
            (feet.isin(OFF_ZONE_FEET), "NO", "MEDIUM", "feet_clear"),
            (timing.isin(EARLY_CONTACT) & (body != "FEET_OR_LOWER_LEGS"), "NO", "MEDIUM", "early_contact"),
        ],
        ("UNCLEAR", "LOW", "unclear"),
    )


def zone_from_feet(feet: str | Column) -> Column:
    f = upper(feet)
    return F.when(f == "DIRECTLY_UNDER", "YES").when(f.isin(OFF_ZONE_FEET), "NO").otherwise("UNCLEAR")


def descent_from_timing(timing: str | Column) -> Column:
    t = upper(timing)
    return (
        F.when(t == "AFTER_RELEASE_DESCENDING", DESCENT_CONTACT).when(t.isin(EARLY_CONTACT), "DURING_SHOT_MOTION").otherwise("UNCLEAR")
    )


def spatial_decision(obs: str = "obs") -> Column:
    """A valid stated label stands. Otherwise the whistle fields decide, then the position fields."""
    def f(name: str) -> Column:
        return upper(f"{obs}.{name}", trim=False)

    stated = upper(f"{obs}.landing_foul")
    falling = (f("contact_moment") == DESCENT_CONTACT) | (f("contact_vs_descent") == DESCENT_CONTACT)
    at, zone = f("defender_position_at_landing"), f("defender_in_landing_zone")
    confidence = upper(F.coalesce(F.col(f"{obs}.confidence"), F.lit("LOW")))
    derived = decide(
        [
            (stated == "YES", "YES", "", "stated"),
            (stated == "NO", "NO", "", "stated"),
            (stated == "UNCLEAR", "UNCLEAR", "", "stated"),
            (f("who_initiated_contact") == "SHOOTER_JUMPED_INTO_DEFENDER", "NO", "", "shooter_initiated"),
            (f("whistle_timing") == "AT_OR_BEFORE_RELEASE", "NO", "", "whistle_early"),
            (f("called_contact") == "ARM_HAND_ON_SHOOTER", "NO", "", "whistle_arm"),
            (
                (f("called_contact") == "DEFENDER_FEET_BODY_UNDER_SHOOTER") & (f("whistle_timing") == DESCENT_CONTACT),
                "YES", "", "whistle_feet",
            ),
            (f("shot_type").isin("DRIVE", "OTHER"), "NO", "", "shot_type"),
            ((at == "UNDER_SHOOTER") & falling, "YES", "", "under_on_descent"),
            ((zone == "YES") & falling, "YES", "", "in_zone_on_descent"),
            (at.isin("NEAR_BUT_LEGAL", "NOT_AT_LANDING") | (zone == "NO"), "NO", "", "clear_of_zone"),
        ],
        ("UNCLEAR", "", "unclear"),
    )
    return F.struct(derived["label"].alias("label"), confidence.alias("confidence"), derived["rule"].alias("rule"))


def timing_to_phase(timing: str | Column) -> Column:
    t = upper(timing)
    return F.when(t == "BEFORE", TIMINGS["BEFORE"]).when(t.isin("DURING", "AFTER"), TIMINGS["DURING"])


def phase_to_timing(phase: Column, ball_state: str | Column, released: str | Column) -> Column:
    after = (F.coalesce(col(ball_state), F.lit("")) == "RELEASED") | F.coalesce(col(released), F.lit(False))
    p = upper(F.coalesce(phase, F.lit("UNKNOWN")), trim=False)
    return F.when(p == "PRE_COMMIT", "BEFORE").when((p == "IN_ACT") & after, "AFTER").when(p == "IN_ACT", "DURING").otherwise("UNKNOWN")


def phase_from_observations(obs: str = "obs") -> Column:
    """PRE_COMMIT or IN_ACT. Doubt falls to PRE_COMMIT; null flags are neither true nor false."""
    def f(name: str) -> Column:
        return upper(f"{obs}.{name}", trim=False)

    def is_(name: str, value: bool) -> Column:
        return F.coalesce(F.col(f"{obs}.{name}") == value, F.lit(False))

    def any_of(names: Sequence[str]) -> Column:
        return F.coalesce(*[F.col(f"{obs}.{n}").cast("string") for n in names]).isNotNull()

    who, ball, arm = f("who_initiated"), f("ball_state_at_contact"), f("arm_geometry")
    short = (
        F.when((who == "SHOOTER") | (arm == "HORIZONTAL_HOOK") | ball.isin("GATHERING", "RISING_NO_RELEASE"), "PRE_COMMIT")
        .when((ball == "RELEASED") | ((ball == "ON_RELEASE_PATH") & (arm == "VERTICAL_SHOT_ARC")), "IN_ACT")
        .otherwise("PRE_COMMIT")
    )
    direction, body, where = f("arm_direction_at_contact"), f("shooter_body_state"), f("ball_location_at_contact")
    veto = (
        is_("shooter_initiates_contact", True) | is_("hook_or_bar_arm", True) | is_("rising_without_release", True)
        | (f("contact_initiator") == "SHOOTER_REACHES_INTO_DEFENDER")
        | direction.isin("HORIZONTAL_OUT", "LATERAL", "UPWARD_BAIT")
        | body.isin("GATHERING", "DRIVE_STEP", "BAIT_RISE")
        | where.isin("HIP", "CHEST")
        | is_("gather_complete_at_contact", False) | is_("could_still_abort", True) | is_("both_hands_on_vertical_arc", False)
    )
    required = (
        is_("gather_complete_at_contact", True) & is_("both_hands_on_vertical_arc", True)
        & is_("shooter_initiates_contact", False) & is_("hook_or_bar_arm", False) & is_("rising_without_release", False)
        & (direction == "UPWARD_SHOT_ARC") & is_("could_still_abort", False)
        & where.isin("ABOVE_SHOULDER", "AT_RELEASE", "RELEASED") & body.isin("SHOT_RELEASE", "LANDING")
    )
    long = (
        F.when(veto, "PRE_COMMIT").when(is_("ball_released_before_contact", True) | required, "IN_ACT").otherwise("PRE_COMMIT")
    )
    stated = upper(F.coalesce(F.col(f"{obs}.phase"), F.lit("UNKNOWN")), trim=False)
    return F.when(any_of(SHORT_FIELDS), short).when(any_of(LONG_FIELDS), long).otherwise(stated)


def normal_phase(obs: str = "obs", mode: str = "observation") -> Column:
    """Consistent (phase, timing). Direct modes trust the stated timing; the others derive the phase first."""
    if mode in ("direct", "sequence"):
        t = upper(F.coalesce(F.col(f"{obs}.timing"), F.lit("UNKNOWN")), trim=False)
        known = t.isin(*TIMINGS)
        return F.struct(
            F.when(known, timing_to_phase(t)).otherwise("UNKNOWN").alias("phase"),
            F.when(known, t).otherwise("UNKNOWN").alias("timing"),
        )
    from_timing = F.when(
        F.col(f"{obs}.phase").isNull() & F.col(f"{obs}.timing").isNotNull(),
        F.coalesce(timing_to_phase(f"{obs}.timing"), F.lit("UNKNOWN")),
    )
    observed = F.coalesce(*[F.col(f"{obs}.{n}").cast("string") for n in SHORT_FIELDS + TRIGGER_FIELDS]).isNotNull()
    phase = F.when(observed, phase_from_observations(obs)).otherwise(
        F.coalesce(from_timing, upper(F.coalesce(F.col(f"{obs}.phase"), F.lit("UNKNOWN")), trim=False))
    )
    return F.struct(
        phase.alias("phase"),
        phase_to_timing(phase, f"{obs}.ball_state_at_contact", f"{obs}.ball_released_before_contact").alias("timing"),
    )


def gate_verdict(precision: str | Column, recall: str | Column) -> Column:
    p, q = col(precision), col(recall)
    chain = None
    for min_p, min_r, verdict in GATES:
        condition = (p >= min_p) if min_r is None else (p >= min_p) & (q >= min_r)
        chain = F.when(condition, verdict) if chain is None else chain.when(condition, verdict)
    return chain.otherwise("BELOW_BASELINE")
