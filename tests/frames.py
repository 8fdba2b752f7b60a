"""Published result values used as fixed test inputs, and small frame builders."""

from tranche.functions.shape import local_table

# Fixed values: (subgrade, loans, defaults) of the published 2015 cohort.
SUBGRADE_COUNTS = [
    ("a1", 1113, 21), ("a2", 1289, 46), ("a3", 1225, 59), ("a4", 1825, 97), ("a5", 2664, 184),
    ("b1", 2378, 185), ("b2", 2595, 202), ("b3", 2830, 287), ("b4", 3261, 364), ("b5", 3259, 427),
    ("c1", 3596, 536), ("c2", 3665, 610), ("c3", 3526, 594), ("c4", 3599, 690), ("c5", 3014, 636),
    ("d1", 2694, 646), ("d2", 2173, 579), ("d3", 2034, 521), ("d4", 2055, 611), ("d5", 1720, 523),
    ("e1", 1699, 514), ("e2", 1480, 466), ("e3", 1341, 471), ("e4", 1096, 359), ("e5", 907, 317),
    ("f1", 764, 273), ("f2", 550, 216), ("f3", 393, 158), ("f4", 333, 156), ("f5", 284, 133),
    ("g1", 226, 88), ("g2", 167, 79), ("g3", 118, 53), ("g4", 76, 32), ("g5", 63, 35),
]
SUBGRADE_AUC = 0.6919443049816046
# Fixed values: (cutoff, accepted, accepted defaults) of the published cutoff policies.
CUTOFF_COUNTS = [
    ("a5", 8116, 407), ("b5", 22439, 1872), ("c5", 39839, 4938), ("d5", 50515, 7818),
    ("e5", 57038, 9945), ("f5", 59362, 10881), ("g5", 60012, 11168),
]
# Fixed values: (policy, acceptance, default rate, bad accepted, good accepted, good rejected).
MODEL_POLICIES = [
    (0.05, 0.05820502566153436, 0.021757801316919553, 1037675.0, 44090875.0, 661895350.0),
    (0.1, 0.22192228221022461, 0.04775491815587926, 8522025.0, 163843000.0, 542143225.0),
    (0.15, 0.3973371992268213, 0.07326483539526106, 23376450.0, 287748300.0, 418237925.0),
    (0.2, 0.5478237685796175, 0.09605791458814941, 42296975.0, 392702000.0, 313284225.0),
    (0.25, 0.6648003732586816, 0.1137958692600762, 62177100.0, 474442525.0, 231543700.0),
    (0.3, 0.7551989602079584, 0.12982943889146312, 81947625.0, 538107275.0, 167878950.0),
    (0.35, 0.8252516163433979, 0.14291771832407874, 101298475.0, 588954000.0, 117032225.0),
    (0.4, 0.8768412984069852, 0.15438703179339047, 118179475.0, 624850550.0, 81135675.0),
    (0.45, 0.9166833300006665, 0.1627281320439177, 132335675.0, 653583575.0, 52402650.0),
]
BASELINE_POLICIES = [
    ("a5", 0.1352396187429181, 0.050147856086742236, 5528350.0, 105707750.0, 600278475.0),
    ("b5", 0.37390855162300873, 0.0834261776371496, 24948200.0, 274991500.0, 430994725.0),
    ("c5", 0.6638505632206892, 0.12394889429955572, 66974100.0, 469295025.0, 236691200.0),
    ("d5", 0.841748317003266, 0.15476591111551025, 110706250.0, 587658225.0, 118328000.0),
    ("e5", 0.9504432446843964, 0.1743574459132508, 147898425.0, 669772425.0, 36213800.0),
    ("f5", 0.9891688329000866, 0.18329908021966915, 166696625.0, 698216550.0, 7769675.0),
    ("g5", 1.0, 0.18609611411051122, 172576125.0, 705986225.0, 0.0),
]
MATCHES = [
    ("a5", 0.05, -118743075.0), ("b5", 0.15, 27085350.0), ("c5", 0.25, 15092000.0), ("d5", 0.35, 11999325.0),
    ("e5", 0.45, -16814950.0), ("f5", 0.45, -54905000.0), ("g5", 0.45, -64564850.0),
]


def frame(spark, schema, *rows):
    """Local frame from value tuples."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return local_table(spark, [dict(zip(names, row, strict=True)) for row in rows], schema)


def policy_table(spark, rows, value_type):
    schema = (
        f"policy_value {value_type}, acceptance_rate double, default_rate_among_accepted double, "
        "accepted_default_loan_amnt double, accepted_non_default_loan_amnt double, rejected_non_default_loan_amnt double, "
        "dataset_name string"
    )
    return frame(spark, schema, *[(*row, "test") for row in rows])
