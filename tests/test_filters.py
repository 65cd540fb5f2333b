"""F1-F6 filter spec semantics, including the proper-subset guards."""

from promoscope.operators.filters import FilterSpec, apply_filters


def frame(spark):
    rows = [("Sprint 3", "Call", "Early (1-2 mo)", "promoter", "speed_quality"),
            ("Sprint 3", "WhatsApp", "Mid (3-6 mo)", "detractor", "reliability"),
            ("Sprint 4", "CleverTap", "Long (6+ mo)", "passive", ""),
            ("Sprint 4", "Unknown", "Unknown", "detractor", "speed_quality")]
    return spark.createDataFrame(rows, "sprint_id string, source string, tenure_cut string, "
                                       "score_band string, theme string")


def sources(df):
    return sorted(r.source for r in df.collect())


def test_channel_subset_is_applied(spark):
    df = frame(spark)
    assert sources(apply_filters(df, FilterSpec(channels=("Call", "WhatsApp")))) == ["Call", "WhatsApp"]


def test_channel_selection_as_long_as_available_is_not_applied(spark):
    df = frame(spark)
    # 4 channels present (Unknown counts): selecting 4 names - even other ones - applies no filter
    spec = FilterSpec(channels=("Call", "WhatsApp", "CleverTap", "Email"))
    assert len(sources(apply_filters(df, spec))) == 4


def test_default_channels_drop_the_others(spark):
    df = frame(spark)
    spec = FilterSpec(channels=("Call", "CleverTap", "WhatsApp"))
    assert sources(apply_filters(df, spec)) == ["Call", "CleverTap", "WhatsApp"]


def test_tenure_guard(spark):
    df = frame(spark)
    assert apply_filters(df, FilterSpec(tenures=("Early (1-2 mo)",))).count() == 1
    all3 = ("Early (1-2 mo)", "Mid (3-6 mo)", "Long (6+ mo)")
    assert apply_filters(df, FilterSpec(tenures=all3)).count() == 4      # all available: no filter
    assert apply_filters(df, FilterSpec(tenures=("Bogus",))).count() == 4  # nothing valid: no filter


def test_period_band_theme(spark):
    df = frame(spark)
    assert apply_filters(df, FilterSpec(grain="sprint", period="Sprint 4")).count() == 2
    assert apply_filters(df, FilterSpec(band="detractor", theme="speed_quality")).count() == 1
