"""Published results on one published layer of nine samples: components, null distributions, threshold models, stability."""

import numpy as np
import pytest

from blocklens.operators import latent, prep, resample
from blocklens.sources import layers

# fixed values: the layer and the numbers published for it
LAYER = """Sample,Groups,ASP,GLU,CYS,ASN,SER,GLN,HIS,GLY,THR,ARG,ALA,GABA,TYR,VAL,MET,TRP,PHE,ILE,LEU,LYS,PRO
Green-1,Green,458251.1,84820.9,958.2,836500.7,136792,333005.8,790155.4,75045.4,107147.6,146814.2,40115.3,162918.7,45276.3,68476.7,7132.2,22973,92031.5,60915,159001.4,100758.7,47548.9
Green-2,Green,457048.1,84264.2,1561.2,824308.1,130711.9,328413.9,779215.3,73630.3,104748.3,144071.5,39179.1,159038.6,44141.4,66480.2,6709.4,22244.4,90981.6,58474.2,151299.2,99038,51463.7
Green-3,Green,482016.1,89497.7,1283.7,870590.1,131058.2,349555.2,809508.5,78257.9,111932.8,151406.8,41602.8,170269.5,46989.2,71142.9,7222.2,23745.1,96986.3,62354.5,162594.3,102941.9,55468.7
Ripe-1,Ripe,58048.9,23313.4,2845.6,514020.3,183738.4,56293.4,1420946.5,84829.2,125162.4,151512,36817.4,212640.2,49477.8,382237,4616.2,20196.9,28466.6,32716.7,498834,95864.3,46348.9
Ripe-2,Ripe,53896.9,21663.4,2447,479284.5,176624.4,53089,1265846.1,81998.8,118275,140007.6,37642.8,200809,46315.5,362461.8,4485,19399.2,25924.9,30642.6,466136.5,87481.5,42259.5
Ripe-3,Ripe,54854.4,21970.1,1550.1,486136,176189.8,54819.8,1266623.8,82002.5,118172.4,141803,30588.5,201908.6,47528.4,366350.2,4535.3,19894.2,27495.5,31454.4,471977,89085.7,42425.9
Over-1,Overripe,60124.2,16513.6,1860,598083,233122.9,80330.3,1322091.5,227068.9,130438.7,238501.3,57160.6,926212.7,95098.9,791538.6,3782.2,31080.4,64032.4,66192.2,461764.8,143997.3,102613.7
Over-2,Overripe,56772.4,15780.3,1234.1,563573.1,222532.2,75542.1,1239743.6,213851.1,122925.5,223533.3,53742.6,878647.3,89130.6,747972.4,3582.7,28451.7,60041.7,63535.4,438075.9,134290.6,93573
Over-3,Overripe,58227.7,16438,1764.2,578064.4,218234.8,78036.3,1281178.2,220608.8,126368.5,231672.5,54737.1,900829,91788.8,767765.6,3667,29761.6,62236.9,67006.1,446796.3,139698.4,100310.6
"""
VIP_WHOLE = dict(GABA=1.405309145999618, ASP=1.3755048919327952, VAL=1.3176860560562615, PHE=1.3145493403572324, GLN=1.308292981817406, ILE=1.1508416701589763, GLY=1.1454906526714708, GLU=1.1196873676710404, PRO=1.0816112113448648, LEU=0.9969457480349767, TYR=0.9382003299667779)
VIP_SPARSE = dict(GABA=1.7093595919293785, ASP=1.6314309235113926, VAL=1.6064147962459534, GLY=1.4157504351687518, GLN=1.4150560348881192, PRO=1.408639708040691, GLU=1.3883031122648493, ILE=1.3760101748356415, PHE=1.2905681173376586, LEU=1.1655900341909065, SER=0.0)
COEFFICIENTS = dict(GABA=0.4884093206423118, GLY=0.4804467204740593, VAL=0.47990943242735373, GLU=-0.4782392537603527, ASP=-0.4645741984751839, MET=-0.46365629510636513, ILE=0.06540714048877821)
STABILITY = dict(ASP=(1.0, 1.6298614319812956, 0.0107945265263738), GABA=(1.0, 1.7078493547991875, 0.01548226170023879), PHE=(0.88, 1.1380064182060334, 0.42040763701760303), ALA=(0.06, 0.08113953305617405, 0.32117493564834726), SER=(0.0, 0.0, 0.0))


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("published") / "layer.csv"
    path.write_text("\ufeff" + LAYER, encoding="utf-8")
    z = prep.prepare_block(layers.load_layer(spark, str(path), "amino_acids")).collect()
    names = [n for _, n in sorted({(r.f_ord, r.feature) for r in z})]
    x = np.zeros((9, len(names)))
    for r in z:
        x[r.s_ord, r.f_ord] = r.value
    group = dict({(r.s_ord, r.grp) for r in z})
    return x, np.array([group[i] for i in range(9)], object), names


@pytest.mark.parametrize("keep, want", [(None, VIP_WHOLE), (5, VIP_SPARSE)])
def test_importance(data, keep, want):
    x, y, names = data
    got = dict(zip(names, latent.SPLSDA(2, keep).fit(latent.Moments.of(x, y)).vip))
    assert len(got) == 21 and all(abs(got[k] - v) < 1e-5 for k, v in want.items())


def test_permutations(spark, data):
    x, y, _ = data
    r = resample.permutation_test(spark, resample.splsda_predictor(2, 5), x, y, 1000)
    assert r["true_accuracy"] == 1.0 and r["n_permutations_run"] == 200 and r["stopped_early"] and abs(r["p_value"] - 0.014925373134328358) < 1e-12
    assert abs(r["mean_null"] - 0.4238888888888889) < 1e-9 and abs(r["std_null"] - 0.23282417994150026) < 1e-9
    rank = np.array([("Green", "Ripe", "Overripe").index(v) for v in y])
    r = resample.permutation_test(spark, resample.ordinal_predictor("AT"), x, rank, 1000)
    assert r["true_accuracy"] == 1.0 and r["n_permutations_run"] == 200 and abs(r["p_value"] - 0.014925373134328358) < 1e-12
    assert abs(r["mean_null"] - 0.22888888888888892) < 1e-9 and abs(r["std_null"] - 0.16983652270475993) < 1e-9


def test_threshold_models(data):
    x, y, names = data
    rank = np.array([("Green", "Ripe", "Overripe").index(v) for v in y])
    for model in ("AT", "IT", "SE"):
        r = resample.ordinal_cross_validation(x, rank, model)
        assert r["accuracy"] == 1.0 and r["mae"] == 0.0 and (r["confusion"] == 3 * np.eye(3)).all()
        if model == "AT":
            got = dict(zip(names, r["coefficients"]))
            assert all(abs(got[k] - v) < 1e-3 for k, v in COEFFICIENTS.items())


def test_stability(spark, data):
    x, y, names = data
    got = {names[r.f]: r for r in resample.stability_selection(spark, resample.splsda_selector(2, 5), x, y, 100).collect()}
    for name, (share, mean, sd) in STABILITY.items():
        assert abs(got[name].selection_frequency - share) < 1e-9 and abs(got[name].mean_vip - mean) < 1e-4 and abs(got[name].std_vip - sd) < 1e-4


def test_forest(data):
    x, y, _ = data
    assert resample.cross_validation(resample.forest_predictor(100), x, y)["accuracy"] == 1.0
