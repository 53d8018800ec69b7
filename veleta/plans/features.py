"""The per-observation feature table, from raw rows to fault flags."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from veleta.operators import preprocess as prep
from veleta.operators import rules
from veleta.operators.baseline import baseline_apply, baseline_fit
from veleta.operators.series import STATION, SeriesLayout
from veleta.operators.spatial import add_spatial_features, knn_stations, station_coords
from veleta.operators.temporal import LAGS, WINDOWS, add_temporal_features


@dataclass
class FeatureModel:
    """What a fit leaves behind: small tables of one or a few rows per station."""

    layout: SeriesLayout
    baselines: DataFrame
    coords: DataFrame
    neighbours: DataFrame
    k: int = 2
    consistency: object | None = None
    lags: tuple[int, ...] = LAGS
    windows: tuple[int, ...] = WINDOWS

    def for_table(self, cleaned: DataFrame, layout: SeriesLayout) -> FeatureModel:
        """The model for another table: measured sizes and neighbours are the table's own, baselines stay.

        Stations that the fit did not see are placed by their first row and find neighbours among all.
        """
        coords = station_coords(cleaned)
        known = self.coords.join(coords.select(STATION), STATION, "left_anti")
        return replace(self, layout=layout, coords=coords, neighbours=knn_stations(coords.unionByName(known), self.k).persist())

    def transform(self, cleaned: DataFrame) -> DataFrame:
        """Temporal, baseline, spatial and cross-sensor features and rule flags of the table that was measured."""
        layout = self.layout
        table = baseline_apply(cleaned, self.baselines, small=layout.small_baselines)
        if not layout.small_groups:
            # Before context rows are added: the statistics are over the station's own rows.
            table = table.join(rules.spike_stats(table, "pressure_hpa_clean", layout), STATION, "left")
        reach = max([*self.lags, *self.windows, rules.DRIFT_ROWS - 1])

        def series(rows: DataFrame) -> DataFrame:
            rows = prep.flag_adjacent_duplicates(prep.flag_temporal_gap(rows, layout), layout)
            rows = add_temporal_features(rows, layout, self.lags, self.windows)
            return rules.apply_fault_rules(rows, layout)

        featured = layout.run(table, series, before=reach, after=rules.DRIFT_ROWS - 1)
        featured = add_spatial_features(featured, self.neighbours, small_network=layout.small_network)
        return self.consistency.transform(featured) if self.consistency else featured


def clean(df: DataFrame, layout: SeriesLayout | None = None) -> DataFrame:
    """Row flags, imputation and clipping; window flags come with the features."""
    layout = layout or SeriesLayout.measure(df)
    return prep.clip_physical(prep.impute(prep.flag_physical(prep.flag_missing(df)), layout))


def fit_features(
    train: DataFrame,
    everything: DataFrame,
    layout: SeriesLayout | None = None,
    k: int = 2,
    lags: tuple[int, ...] = LAGS,
    windows: tuple[int, ...] = WINDOWS,
    consistency: bool = False,
    baselines: DataFrame | None = None,
) -> FeatureModel:
    """Fit on cleaned training rows; neighbours come from all stations' coordinates.

    ``baselines`` may be given where they are fitted already.
    """
    from veleta.operators.multivariate import fit_consistency

    layout = layout or SeriesLayout.measure(everything)
    coords = station_coords(everything).persist()
    return FeatureModel(
        layout,
        # Small next to the observations and read by every transform.
        baseline_fit(train, layout).persist() if baselines is None else baselines,
        coords,
        knn_stations(coords, k).persist(),
        k,
        fit_consistency(train) if consistency else None,
        lags,
        windows,
    )
