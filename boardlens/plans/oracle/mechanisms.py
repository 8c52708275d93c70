"""Shared expressions for mechanisms: the catalogue, written out, and drift warnings."""

from boardlens.plans.oracle import define

define("mechanism_extents", """
SELECT * FROM (VALUES
 (0, 'aperture_clogging', 'UNDER', 'single_pad', true), (0, 'aperture_clogging', 'UNDER', 'component_multi_pad', true), (0, 'aperture_clogging', 'UNDER', 'local_area', true),
 (1, 'poor_release', 'UNDER', 'single_pad', false), (1, 'poor_release', 'UNDER', 'local_area', false),
 (2, 'understencil_residue', 'OVER', 'single_pad', true), (2, 'understencil_residue', 'OVER', 'component_multi_pad', true),
 (3, 'poor_gasketing', 'BOTH', 'local_area', false), (3, 'poor_gasketing', 'BOTH', 'component_multi_pad', false),
 (4, 'slump', 'OVER', 'board_wide', true), (4, 'slump', 'OVER', 'local_area', true), (5, 'paste_rheology_drift', 'BOTH', 'board_wide', true),
 (6, 'supply_interruption', 'UNDER', 'board_wide', false), (7, 'parameter_mismatch', 'BOTH', 'board_wide', false), (7, 'parameter_mismatch', 'BOTH', 'local_area', false),
 (8, 'squeegee_one_side', 'BOTH', 'board_wide', false), (8, 'squeegee_one_side', 'BOTH', 'local_area', false),
 (9, 'cleaning_cycle_mismatch', 'OVER', 'single_pad', true), (9, 'cleaning_cycle_mismatch', 'OVER', 'local_area', true),
 (10, 'alignment_offset', 'BOTH', 'board_wide', false), (10, 'alignment_offset', 'BOTH', 'local_area', false), (11, 'spi_false_call', 'BOTH', 'single_pad', false)
) m(place, mechanism, way, extent, early)
""")
define("mechanism_times", """
SELECT * FROM (VALUES
 ('aperture_clogging', 'consecutive'), ('aperture_clogging', 'periodic'), ('poor_release', 'consecutive'), ('poor_release', 'repeated'),
 ('understencil_residue', 'consecutive'), ('understencil_residue', 'periodic'), ('poor_gasketing', 'consecutive'), ('poor_gasketing', 'repeated'),
 ('slump', 'consecutive'), ('paste_rheology_drift', 'consecutive'), ('supply_interruption', 'sporadic'), ('parameter_mismatch', 'consecutive'),
 ('squeegee_one_side', 'repeated'), ('cleaning_cycle_mismatch', 'periodic'), ('alignment_offset', 'consecutive'), ('spi_false_call', 'repeated')
) m(mechanism, timing)
""")
define("drift_warnings", """
SELECT *, CASE WHEN end_index IS NULL THEN 'active' ELSE 'recovered' END AS status, end_index IS NULL AND boards_above >= 100 AS pending_new_baseline,
 end_index IS NULL AND level >= 3 AND boards_above < 100 AS page_alert FROM drift_episodes
""")
