"""Plant and genus dimensions as DataFrames; both are small, fixed tables, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLANT_SCHEMA = "ord int, key string, common string, botanical string, type string, size string, bloom string, sun string, water string, notes string, photos array<string>"
GENUS_SCHEMA = "genus string, type string, sun string, water string, bloom string, notes string"

# Key | common | botanical | type | size | bloom | sun | water | notes, in order of precedence.
PLANTS = """
boxwood | Boxwood | Buxus sempervirens | evergreen-shrub | 3-5 ft tall, 3-5 ft wide | Spring (inconspicuous) | full-sun | moderate | Classic evergreen hedge plant. Dense, rounded form. Deer resistant.
hydrangea | Hydrangea | Hydrangea macrophylla | deciduous-shrub | 4-6 ft tall, 4-6 ft wide | Summer - Fall | part-sun | high | Showy clusters of blue, pink, or white flowers. Color varies with soil pH.
lavender | Lavender | Lavandula angustifolia | perennial | 1-3 ft tall, 1-3 ft wide | Summer | full-sun | low | Fragrant purple flowers. Excellent for pollinators. Deer and rabbit resistant.
hosta | Hosta | Hosta spp. | perennial | 1-3 ft tall, 2-4 ft wide | Summer | part-shade | moderate | Shade-loving foliage plant. Available in many leaf colors and patterns.
daylily | Daylily | Hemerocallis spp. | perennial | 1-4 ft tall, 1-3 ft wide | Summer | full-sun | moderate | Easy-care perennial with trumpet-shaped flowers in many colors. Each bloom lasts one day.
japanese maple | Japanese Maple | Acer palmatum | deciduous-tree | 10-25 ft tall, 10-25 ft wide | Spring (inconspicuous) | part-sun | moderate | Elegant ornamental tree with delicate, deeply lobed leaves. Stunning fall color.
crepe myrtle | Crepe Myrtle | Lagerstroemia indica | deciduous-tree | 10-30 ft tall, 10-20 ft wide | Summer - Fall | full-sun | moderate | Long-blooming tree with showy flower clusters. Attractive peeling bark. Heat tolerant.
knockout rose | Knockout Rose | Rosa 'Knock Out' | deciduous-shrub | 3-4 ft tall, 3-4 ft wide | Spring - Fall | full-sun | moderate | Continuous blooming, disease-resistant shrub rose. Low maintenance.
blue fescue | Blue Fescue | Festuca glauca | ornamental-grass | 6-12 in tall, 6-10 in wide | Summer | full-sun | low | Compact blue-silver mounding grass. Deer resistant. Great for borders and rock gardens.
liriope | Liriope | Liriope muscari | perennial | 12-18 in tall, 12-18 in wide | Late Summer - Fall | part-shade | moderate | Grass-like evergreen groundcover. Purple flower spikes. Very low maintenance.
azalea | Azalea | Rhododendron spp. | evergreen-shrub | 3-6 ft tall, 3-6 ft wide | Spring | part-shade | moderate | Showy spring blooms in white, pink, red, or purple. Prefers acidic soil.
camellia | Camellia | Camellia japonica | evergreen-shrub | 6-12 ft tall, 5-10 ft wide | Winter - Spring | part-shade | moderate | Glossy evergreen with rose-like flowers in winter. Prefers acidic, well-drained soil.
gardenia | Gardenia | Gardenia jasminoides | evergreen-shrub | 3-6 ft tall, 3-6 ft wide | Late Spring - Summer | part-sun | moderate | Intensely fragrant white flowers. Glossy dark green foliage. Needs acidic soil.
ornamental grass | Ornamental Grass | Miscanthus sinensis | ornamental-grass | 4-7 ft tall, 3-5 ft wide | Late Summer - Fall | full-sun | moderate | Tall graceful grass with feathery plumes. Great for screens and borders.
fountain grass | Fountain Grass | Pennisetum alopecuroides | ornamental-grass | 2-4 ft tall, 2-3 ft wide | Summer - Fall | full-sun | low | Graceful arching form with fuzzy bottlebrush flower plumes.
black-eyed susan | Black-Eyed Susan | Rudbeckia fulgida | perennial | 2-3 ft tall, 1-2 ft wide | Summer - Fall | full-sun | moderate | Bright yellow daisy-like flowers with dark centers. Native wildflower. Great for pollinators.
coneflower | Coneflower | Echinacea purpurea | perennial | 2-4 ft tall, 1-2 ft wide | Summer - Fall | full-sun | low | Purple daisy-like flowers. Native plant, great for pollinators and butterflies.
salvia | Salvia | Salvia nemorosa | perennial | 1-3 ft tall, 1-2 ft wide | Late Spring - Summer | full-sun | low | Spiky purple-blue flower stalks. Deer resistant. Attracts hummingbirds.
russian sage | Russian Sage | Perovskia atriplicifolia | perennial | 3-5 ft tall, 3-4 ft wide | Summer - Fall | full-sun | low | Airy lavender-blue flower spires with silvery foliage. Extremely drought tolerant.
holly | Holly | Ilex spp. | evergreen-shrub | 6-15 ft tall, 6-10 ft wide | Spring (inconspicuous) | part-sun | moderate | Glossy evergreen with red berries in winter. Great for hedges and screening.
juniper | Juniper | Juniperus spp. | evergreen-shrub | 1-15 ft tall (varies by cultivar) | Spring (inconspicuous) | full-sun | low | Versatile evergreen. Groundcover to upright forms. Very drought tolerant.
viburnum | Viburnum | Viburnum spp. | deciduous-shrub | 5-12 ft tall, 5-10 ft wide | Spring | part-sun | moderate | Clusters of white or pink flowers. Many species offer fall berries and good fall color.
dogwood | Dogwood | Cornus florida | deciduous-tree | 15-25 ft tall, 15-25 ft wide | Spring | part-sun | moderate | Native ornamental tree with showy spring bracts. Red berries and purple fall foliage.
magnolia | Magnolia | Magnolia grandiflora | evergreen-tree | 40-80 ft tall, 30-50 ft wide | Late Spring - Summer | full-sun | moderate | Large fragrant white flowers. Glossy evergreen leaves. Iconic Southern tree.
tulip | Tulip | Tulipa spp. | perennial-bulb | 6-24 in tall | Spring | full-sun | moderate | Classic spring bulb available in virtually every color. Plant in fall for spring blooms.
daffodil | Daffodil | Narcissus spp. | perennial-bulb | 6-20 in tall | Early Spring | full-sun | moderate | Cheerful spring bulb. Deer and rodent resistant. Naturalizes easily.
iris | Iris | Iris germanica | perennial | 1-3 ft tall, 1-2 ft wide | Spring - Early Summer | full-sun | low | Elegant bearded flowers in many colors. Sword-shaped foliage. Drought tolerant once established.
peony | Peony | Paeonia lactiflora | perennial | 2-3 ft tall, 2-3 ft wide | Late Spring | full-sun | moderate | Large, fragrant, ruffled flowers. Long-lived perennial. May need staking when in bloom.
astilbe | Astilbe | Astilbe spp. | perennial | 1-4 ft tall, 1-3 ft wide | Summer | part-shade | high | Feathery plume flowers in pink, red, white, or purple. Great for shady, moist areas.
fern | Fern | Various | fern | 1-4 ft tall, 1-3 ft wide | Non-flowering | full-shade | high | Ancient non-flowering plant. Elegant fronds for shaded areas. Many species available.
sedum | Sedum | Sedum spp. | succulent | 3 in - 2 ft tall (varies) | Summer - Fall | full-sun | low | Succulent perennial. Extremely drought tolerant. Attractive to butterflies.
yew | Yew | Taxus spp. | evergreen-shrub | 3-20 ft tall (varies by cultivar) | Spring (inconspicuous) | part-shade | moderate | Dense evergreen, excellent for formal hedges and foundation plantings. Shade tolerant.
spirea | Spirea | Spiraea spp. | deciduous-shrub | 2-6 ft tall, 2-6 ft wide | Spring - Summer | full-sun | moderate | Easy-care flowering shrub. Clusters of white, pink, or red flowers.
barberry | Barberry | Berberis thunbergii | deciduous-shrub | 3-6 ft tall, 4-7 ft wide | Spring | full-sun | low | Colorful foliage in purple, red, gold, or green. Thorny — good for barrier planting. Deer resistant.
clematis | Clematis | Clematis spp. | vine | 8-20 ft tall (climbing) | Spring - Fall (varies by species) | full-sun | moderate | Flowering vine with showy blooms in many colors. Likes cool roots, warm tops.
wisteria | Wisteria | Wisteria sinensis | vine | 15-30 ft (climbing) | Spring | full-sun | moderate | Dramatic cascading clusters of fragrant purple or white flowers. Vigorous grower — needs strong support.
ivy | Ivy | Hedera helix | ground-cover | 6-8 in tall (groundcover), climbs to 80 ft | Fall (inconspicuous) | part-shade | moderate | Vigorous evergreen groundcover and climber. Can be invasive — needs management.
pachysandra | Pachysandra | Pachysandra terminalis | ground-cover | 6-12 in tall, spreading | Spring (inconspicuous) | full-shade | moderate | Dense evergreen groundcover for shaded areas. Low maintenance once established.
rhododendron | Rhododendron | Rhododendron spp. | evergreen-shrub | 4-10 ft tall, 4-10 ft wide | Spring | part-shade | moderate | Large, showy flower clusters. Evergreen foliage. Prefers acidic, well-drained soil.
lantana | Lantana | Lantana camara | perennial | 1-4 ft tall, 2-4 ft wide | Spring - Fall | full-sun | low | Multicolored flower clusters. Extremely heat and drought tolerant. Attracts butterflies.
catmint | Catmint | Nepeta faassenii | perennial | 1-3 ft tall, 1-3 ft wide | Late Spring - Fall | full-sun | low | Profuse lavender-blue flowers. Aromatic gray-green foliage. Deer and rabbit resistant.
rose of sharon | Rose of Sharon | Hibiscus syriacus | deciduous-shrub | 8-12 ft tall, 6-10 ft wide | Summer - Fall | full-sun | moderate | Late-blooming shrub with hibiscus-like flowers. Upright vase shape.
nandina | Nandina | Nandina domestica | evergreen-shrub | 4-8 ft tall, 3-5 ft wide | Spring | part-sun | moderate | Heavenly bamboo. Colorful foliage year-round, bright red in winter. Red berries.
agapanthus | Agapanthus | Agapanthus africanus | perennial | 2-3 ft tall, 1-2 ft wide | Summer | full-sun | moderate | Lily of the Nile. Globes of blue or white flowers on tall stalks. Strap-like leaves.
mondo grass | Mondo Grass | Ophiopogon japonicus | ground-cover | 4-12 in tall, spreading | Summer (inconspicuous) | part-shade | moderate | Dense, dark green grass-like groundcover. Excellent for borders and between stepping stones.
mexican feather grass | Mexican Feather Grass | Nassella tenuissima | ornamental-grass | 1-2 ft tall, 1-2 ft wide | Summer | full-sun | low | Fine, wispy, thread-like foliage that sways in the breeze. Very drought tolerant.
coral bells | Coral Bells | Heuchera spp. | perennial | 8-18 in tall, 12-18 in wide | Late Spring - Summer | part-shade | moderate | Grown primarily for colorful foliage in purple, lime, coral, silver. Delicate flower spikes.
arborvitae | Arborvitae | Thuja occidentalis | evergreen-tree | 10-30 ft tall, 3-12 ft wide | Spring (inconspicuous) | full-sun | moderate | Columnar or pyramidal evergreen. Popular for privacy screens and hedges.
"""

# Genus | type | sun | water | bloom | notes. A genus that comes twice has its last row's values.
GENERA = """
acer | deciduous-tree | part-sun | moderate |  | Maple family
quercus | deciduous-tree | full-sun | moderate |  | Oak family
betula | deciduous-tree | full-sun | moderate |  | Birch family
cornus | deciduous-tree | part-sun | moderate |  | Dogwood family
prunus | deciduous-tree | full-sun | moderate | Spring | Cherry/Plum family
malus | deciduous-tree | full-sun | moderate | Spring | Apple/Crabapple family
magnolia | deciduous-tree | full-sun | moderate | Spring | Magnolia family
cercis | deciduous-tree | full-sun | moderate | Early Spring | Redbud family
lagerstroemia | deciduous-tree | full-sun | moderate | Summer | Crepe myrtle family
picea | evergreen-tree | full-sun | moderate |  | Spruce family
pinus | evergreen-tree | full-sun | low |  | Pine family
thuja | evergreen-tree | full-sun | moderate |  | Arborvitae family
tsuga | evergreen-tree | part-shade | moderate |  | Hemlock family
abies | evergreen-tree | full-sun | moderate |  | Fir family
cedrus | evergreen-tree | full-sun | low |  | Cedar family
cryptomeria | evergreen-tree | full-sun | moderate |  | Japanese cedar
metasequoia | deciduous-tree | full-sun | moderate |  | Dawn redwood
ginkgo | deciduous-tree | full-sun | moderate |  | Ginkgo - living fossil
amelanchier | deciduous-tree | part-sun | moderate | Spring | Serviceberry family
carpinus | deciduous-tree | part-sun | moderate |  | Hornbeam family
fagus | deciduous-tree | part-sun | moderate |  | Beech family
liquidambar | deciduous-tree | full-sun | moderate |  | Sweetgum
nyssa | deciduous-tree | full-sun | high |  | Tupelo/Black gum
liriodendron | deciduous-tree | full-sun | moderate |  | Tulip tree
styrax | deciduous-tree | part-sun | moderate | Spring | Snowbell family
halesia | deciduous-tree | part-sun | moderate | Spring | Silverbell family
oxydendrum | deciduous-tree | full-sun | moderate | Summer | Sourwood
chionanthus | deciduous-tree | full-sun | moderate | Spring | Fringetree
cladrastis | deciduous-tree | full-sun | moderate | Spring | Yellowwood
zelkova | deciduous-tree | full-sun | moderate |  | Elm relative
parrotia | deciduous-tree | full-sun | moderate |  | Persian ironwood
ilex | evergreen-shrub | part-sun | moderate |  | Holly family
buxus | evergreen-shrub | part-sun | moderate |  | Boxwood family
rhododendron | evergreen-shrub | part-shade | moderate | Spring | Rhododendron/Azalea family
camellia | evergreen-shrub | part-shade | moderate | Winter-Spring | Camellia family
pieris | evergreen-shrub | part-shade | moderate | Early Spring | Andromeda family
leucothoe | evergreen-shrub | part-shade | moderate |  | Drooping leucothoe
kalmia | evergreen-shrub | part-shade | moderate | Late Spring | Mountain laurel
prunus | evergreen-shrub | full-sun | moderate |  | Cherry laurel (evergreen varieties)
aucuba | evergreen-shrub | full-shade | moderate |  | Gold dust plant
nandina | evergreen-shrub | part-sun | moderate |  | Heavenly bamboo
osmanthus | evergreen-shrub | part-sun | moderate | Fall | Fragrant olive
ligustrum | evergreen-shrub | full-sun | moderate |  | Privet family
euonymus | evergreen-shrub | full-sun | moderate |  | Euonymus family
skimmia | evergreen-shrub | part-shade | moderate |  | Skimmia
sarcococca | evergreen-shrub | full-shade | moderate | Winter | Sweet box
cephalotaxus | evergreen-shrub | part-shade | moderate |  | Plum yew
taxus | evergreen-shrub | part-shade | moderate |  | Yew family
juniperus | evergreen-shrub | full-sun | low |  | Juniper family
chamaecyparis | evergreen-shrub | full-sun | moderate |  | False cypress
microbiota | evergreen-shrub | part-shade | moderate |  | Russian cypress
abelia | evergreen-shrub | full-sun | moderate | Summer-Fall | Abelia family
loropetalum | evergreen-shrub | part-sun | moderate | Spring | Chinese fringe flower
illicium | evergreen-shrub | part-shade | moderate |  | Anise tree
cleyera | evergreen-shrub | part-shade | moderate |  | Japanese cleyera
ternstroemia | evergreen-shrub | part-shade | moderate |  | Cleyera relative
gardenia | evergreen-shrub | part-sun | moderate | Summer | Fragrant gardenia
distylium | evergreen-shrub | part-sun | moderate |  | Distylium
hydrangea | deciduous-shrub | part-sun | high | Summer | Hydrangea family
viburnum | deciduous-shrub | part-sun | moderate | Spring | Viburnum family
spiraea | deciduous-shrub | full-sun | moderate | Spring-Summer | Spirea family
weigela | deciduous-shrub | full-sun | moderate | Late Spring | Weigela family
forsythia | deciduous-shrub | full-sun | moderate | Early Spring | Forsythia
syringa | deciduous-shrub | full-sun | moderate | Spring | Lilac family
philadelphus | deciduous-shrub | full-sun | moderate | Late Spring | Mock orange
deutzia | deciduous-shrub | full-sun | moderate | Spring | Deutzia family
fothergilla | deciduous-shrub | part-sun | moderate | Spring | Fothergilla - great fall color
itea | deciduous-shrub | part-sun | high | Summer | Virginia sweetspire
clethra | deciduous-shrub | part-shade | high | Summer | Summersweet
callicarpa | deciduous-shrub | full-sun | moderate |  | Beautyberry - purple berries
berberis | deciduous-shrub | full-sun | low |  | Barberry family
cotinus | deciduous-shrub | full-sun | low | Summer | Smoke bush
hibiscus | deciduous-shrub | full-sun | moderate | Summer-Fall | Rose of Sharon
hamamelis | deciduous-shrub | part-sun | moderate | Winter-Spring | Witch hazel
corylopsis | deciduous-shrub | part-shade | moderate | Early Spring | Winter hazel
edgeworthia | deciduous-shrub | part-shade | moderate | Winter | Paperbush
calycanthus | deciduous-shrub | part-sun | moderate | Late Spring | Sweetshrub
hypericum | deciduous-shrub | full-sun | moderate | Summer | St. John's wort
physocarpus | deciduous-shrub | full-sun | moderate | Spring | Ninebark
aronia | deciduous-shrub | full-sun | moderate | Spring | Chokeberry
sambucus | deciduous-shrub | full-sun | moderate | Summer | Elderberry
lindera | deciduous-shrub | part-sun | moderate | Early Spring | Spicebush
myrica | deciduous-shrub | full-sun | moderate |  | Bayberry
rosa | deciduous-shrub | full-sun | moderate | Spring-Fall | Rose family
hosta | perennial | part-shade | moderate | Summer | Shade-loving foliage plant
heuchera | perennial | part-shade | moderate | Summer | Coral bells - colorful foliage
astilbe | perennial | part-shade | high | Summer | Feathery plumes for shade
helleborus | perennial | part-shade | moderate | Late Winter-Spring | Lenten rose
epimedium | perennial | part-shade | moderate | Spring | Barrenwort - great groundcover
brunnera | perennial | part-shade | moderate | Spring | Siberian bugloss
pulmonaria | perennial | part-shade | moderate | Spring | Lungwort
tiarella | perennial | part-shade | moderate | Spring | Foamflower
heucherella | perennial | part-shade | moderate | Spring | Heuchera x Tiarella hybrid
polygonatum | perennial | part-shade | moderate | Spring | Solomon's seal
disporum | perennial | part-shade | moderate | Spring | Fairy bells
anemone | perennial | part-sun | moderate | Fall | Japanese anemone
echinacea | perennial | full-sun | low | Summer | Coneflower
rudbeckia | perennial | full-sun | moderate | Summer-Fall | Black-eyed Susan
salvia | perennial | full-sun | low | Summer | Sage family
nepeta | perennial | full-sun | low | Spring-Fall | Catmint
lavandula | perennial | full-sun | low | Summer | Lavender
perovskia | perennial | full-sun | low | Summer-Fall | Russian sage
sedum | perennial | full-sun | low | Summer-Fall | Stonecrop
geranium | perennial | part-sun | moderate | Spring-Summer | Hardy geranium (cranesbill)
phlox | perennial | full-sun | moderate | Summer | Phlox family
leucanthemum | perennial | full-sun | moderate | Summer | Shasta daisy
coreopsis | perennial | full-sun | low | Summer | Tickseed
gaillardia | perennial | full-sun | low | Summer | Blanket flower
agastache | perennial | full-sun | low | Summer | Hyssop - attracts pollinators
monarda | perennial | full-sun | moderate | Summer | Bee balm
achillea | perennial | full-sun | low | Summer | Yarrow
paeonia | perennial | full-sun | moderate | Late Spring | Peony
iris | perennial | full-sun | moderate | Spring | Iris family
hemerocallis | perennial | full-sun | moderate | Summer | Daylily
agapanthus | perennial | full-sun | moderate | Summer | Lily of the Nile
liatris | perennial | full-sun | low | Summer | Blazing star
veronica | perennial | full-sun | moderate | Summer | Speedwell
amsonia | perennial | full-sun | moderate | Spring | Blue star - great fall color
baptisia | perennial | full-sun | low | Spring | False indigo
euphorbia | perennial | full-sun | low | Spring | Spurge family
dianthus | perennial | full-sun | low | Spring-Summer | Pinks
campanula | perennial | part-sun | moderate | Summer | Bellflower
digitalis | perennial | part-sun | moderate | Early Summer | Foxglove
aquilegia | perennial | part-shade | moderate | Spring | Columbine
delphinium | perennial | full-sun | moderate | Summer | Larkspur
kniphofia | perennial | full-sun | moderate | Summer | Red hot poker
crocosmia | perennial | full-sun | moderate | Summer | Montbretia
alchemilla | perennial | part-sun | moderate | Summer | Lady's mantle
stachys | perennial | full-sun | low | Summer | Lamb's ear
artemisia | perennial | full-sun | low |  | Silvery foliage plant
ajuga | ground-cover | part-shade | moderate | Spring | Bugleweed groundcover
vinca | ground-cover | part-shade | moderate | Spring | Periwinkle groundcover
pachysandra | ground-cover | full-shade | moderate |  | Japanese spurge groundcover
liriope | ground-cover | part-shade | moderate | Late Summer | Lilyturf
ophiopogon | ground-cover | part-shade | moderate |  | Mondo grass
hakonechloa | ornamental-grass | part-shade | moderate |  | Japanese forest grass
miscanthus | ornamental-grass | full-sun | moderate | Late Summer | Maiden grass
panicum | ornamental-grass | full-sun | moderate | Fall | Switch grass
pennisetum | ornamental-grass | full-sun | low | Summer | Fountain grass
calamagrostis | ornamental-grass | full-sun | moderate | Summer | Feather reed grass
festuca | ornamental-grass | full-sun | low |  | Blue fescue
carex | ornamental-grass | part-shade | moderate |  | Sedge family
nassella | ornamental-grass | full-sun | low |  | Mexican feather grass
schizachyrium | ornamental-grass | full-sun | low | Fall | Little bluestem
muhlenbergia | ornamental-grass | full-sun | low | Fall | Muhly grass
sporobolus | ornamental-grass | full-sun | low | Fall | Prairie dropseed
andropogon | ornamental-grass | full-sun | low | Fall | Big bluestem
chasmanthium | ornamental-grass | part-shade | moderate | Summer | Northern sea oats
sesleria | ornamental-grass | part-sun | moderate |  | Moor grass
deschampsia | ornamental-grass | part-sun | moderate | Summer | Tufted hair grass
molinia | ornamental-grass | full-sun | moderate | Fall | Moor grass
juncus | ornamental-grass | full-sun | high |  | Rush family
acorus | ornamental-grass | full-sun | high |  | Sweet flag
athyrium | fern | part-shade | moderate |  | Lady fern
dryopteris | fern | part-shade | moderate |  | Wood fern
polystichum | fern | part-shade | moderate |  | Christmas/Shield fern
osmunda | fern | part-shade | high |  | Royal fern
matteuccia | fern | part-shade | high |  | Ostrich fern
adiantum | fern | part-shade | moderate |  | Maidenhair fern
cyrtomium | fern | part-shade | moderate |  | Holly fern
clematis | vine | full-sun | moderate | Spring-Fall | Flowering vine
wisteria | vine | full-sun | moderate | Spring | Cascading flower clusters
lonicera | vine | full-sun | moderate | Summer | Honeysuckle
hydrangea | vine | part-shade | moderate | Summer | Climbing hydrangea
schizophragma | vine | part-shade | moderate | Summer | Japanese hydrangea vine
parthenocissus | vine | part-sun | moderate |  | Virginia creeper / Boston ivy
campsis | vine | full-sun | moderate | Summer | Trumpet vine
trachelospermum | vine | part-sun | moderate | Spring | Star jasmine
hedera | vine | part-shade | moderate |  | Ivy
gelsemium | vine | full-sun | moderate | Early Spring | Carolina jessamine
bignonia | vine | full-sun | moderate | Spring | Crossvine
decumaria | vine | part-shade | moderate | Summer | Climbing hydrangea relative
ficus | vine | part-shade | moderate |  | Climbing fig
"""


# Key | photo, in order.
PHOTOS = """
boxwood | https://upload.wikimedia.org/wikipedia/commons/thumb/7/7f/Buxus_sempervirens0.jpg/800px-Buxus_sempervirens0.jpg
boxwood | https://upload.wikimedia.org/wikipedia/commons/thumb/a/af/Buxus_sempervirens_%27Suffruticosa%27.jpg/800px-Buxus_sempervirens_%27Suffruticosa%27.jpg
hydrangea | https://upload.wikimedia.org/wikipedia/commons/thumb/e/e8/Hydrangea_macrophylla_-_Hortensia_hydrangea.jpg/800px-Hydrangea_macrophylla_-_Hortensia_hydrangea.jpg
lavender | https://upload.wikimedia.org/wikipedia/commons/thumb/6/60/Lavandula_angustifolia_-_0001.jpg/800px-Lavandula_angustifolia_-_0001.jpg
hosta | https://upload.wikimedia.org/wikipedia/commons/thumb/4/41/Hosta_%27Sagae%27.jpg/800px-Hosta_%27Sagae%27.jpg
daylily | https://upload.wikimedia.org/wikipedia/commons/thumb/c/c9/Hemerocallis_lilioasphodelus_2.jpg/800px-Hemerocallis_lilioasphodelus_2.jpg
japanese maple | https://upload.wikimedia.org/wikipedia/commons/thumb/4/4f/Acer_palmatum_var_amoenum_%27Osakazuki%27_JPG1a.jpg/800px-Acer_palmatum_var_amoenum_%27Osakazuki%27_JPG1a.jpg
crepe myrtle | https://upload.wikimedia.org/wikipedia/commons/thumb/4/4b/Lagerstroemia_indica_flowers.jpg/800px-Lagerstroemia_indica_flowers.jpg
knockout rose | https://upload.wikimedia.org/wikipedia/commons/thumb/e/e6/Rosa_Knock_Out_2.jpg/800px-Rosa_Knock_Out_2.jpg
blue fescue | https://upload.wikimedia.org/wikipedia/commons/thumb/5/5b/Festuca_glauca_a1.jpg/800px-Festuca_glauca_a1.jpg
liriope | https://upload.wikimedia.org/wikipedia/commons/thumb/c/cd/Liriope_muscari1.jpg/800px-Liriope_muscari1.jpg
azalea | https://upload.wikimedia.org/wikipedia/commons/thumb/a/a7/Azalea_japonica.jpg/800px-Azalea_japonica.jpg
camellia | https://upload.wikimedia.org/wikipedia/commons/thumb/3/33/Camellia_japonica_flower_2.jpg/800px-Camellia_japonica_flower_2.jpg
gardenia | https://upload.wikimedia.org/wikipedia/commons/thumb/4/41/Gardenia_jasminoides_cv1.jpg/800px-Gardenia_jasminoides_cv1.jpg
ornamental grass | https://upload.wikimedia.org/wikipedia/commons/thumb/0/01/Miscanthus_sinensis_var._condensatus_%27Cosmopolitan%27.jpg/800px-Miscanthus_sinensis_var._condensatus_%27Cosmopolitan%27.jpg
fountain grass | https://upload.wikimedia.org/wikipedia/commons/thumb/1/1a/Pennisetum_alopecuroides_Hameln2.jpg/800px-Pennisetum_alopecuroides_Hameln2.jpg
black-eyed susan | https://upload.wikimedia.org/wikipedia/commons/thumb/4/41/Rudbeckia_fulgida_var_sullivantii_%27Goldsturm%27.jpg/800px-Rudbeckia_fulgida_var_sullivantii_%27Goldsturm%27.jpg
coneflower | https://upload.wikimedia.org/wikipedia/commons/thumb/6/6e/Echinacea_purpurea_02.jpg/800px-Echinacea_purpurea_02.jpg
salvia | https://upload.wikimedia.org/wikipedia/commons/thumb/1/1d/Salvia_nemorosa_%27Caradonna%27_01.JPG/800px-Salvia_nemorosa_%27Caradonna%27_01.JPG
russian sage | https://upload.wikimedia.org/wikipedia/commons/thumb/d/d5/Perovskia_atriplicifolia_002.JPG/800px-Perovskia_atriplicifolia_002.JPG
holly | https://upload.wikimedia.org/wikipedia/commons/thumb/a/ac/Ilex_aquifolium_fruits.jpg/800px-Ilex_aquifolium_fruits.jpg
juniper | https://upload.wikimedia.org/wikipedia/commons/thumb/e/e3/Juniperus_chinensis_Pfitzeriana_Aurea_1.jpg/800px-Juniperus_chinensis_Pfitzeriana_Aurea_1.jpg
viburnum | https://upload.wikimedia.org/wikipedia/commons/thumb/5/5e/Viburnum_opulus_flowers.jpg/800px-Viburnum_opulus_flowers.jpg
dogwood | https://upload.wikimedia.org/wikipedia/commons/thumb/8/8d/Cornus_florida_flowers.jpg/800px-Cornus_florida_flowers.jpg
magnolia | https://upload.wikimedia.org/wikipedia/commons/thumb/a/a5/Magnolia_grandiflora_flower.jpg/800px-Magnolia_grandiflora_flower.jpg
tulip | https://upload.wikimedia.org/wikipedia/commons/thumb/4/44/Tulip_-_florAnswer.jpg/800px-Tulip_-_florAnswer.jpg
daffodil | https://upload.wikimedia.org/wikipedia/commons/thumb/3/3d/Narcissus_pseudonarcissus_%28daffodils%29.jpg/800px-Narcissus_pseudonarcissus_%28daffodils%29.jpg
iris | https://upload.wikimedia.org/wikipedia/commons/thumb/4/49/Iris_germanica_%28Purple_bearded_iris%29%2C_Giverny.jpg/800px-Iris_germanica_%28Purple_bearded_iris%29%2C_Giverny.jpg
peony | https://upload.wikimedia.org/wikipedia/commons/thumb/d/da/Paeonia_lactiflora1.jpg/800px-Paeonia_lactiflora1.jpg
astilbe | https://upload.wikimedia.org/wikipedia/commons/thumb/4/44/Astilbe_japonica_%27Europa%27.JPG/800px-Astilbe_japonica_%27Europa%27.JPG
fern | https://upload.wikimedia.org/wikipedia/commons/thumb/4/4a/Athyrium_filix-femina_1.jpg/800px-Athyrium_filix-femina_1.jpg
sedum | https://upload.wikimedia.org/wikipedia/commons/thumb/3/33/Sedum_telephium_ssp_maximum.jpg/800px-Sedum_telephium_ssp_maximum.jpg
yew | https://upload.wikimedia.org/wikipedia/commons/thumb/e/e1/Taxus_baccata_%28European_Yew%29.jpg/800px-Taxus_baccata_%28European_Yew%29.jpg
spirea | https://upload.wikimedia.org/wikipedia/commons/thumb/8/8c/Spiraea_japonica1.jpg/800px-Spiraea_japonica1.jpg
barberry | https://upload.wikimedia.org/wikipedia/commons/thumb/4/49/Berberis_thunbergii_var_atropurpurea.jpg/800px-Berberis_thunbergii_var_atropurpurea.jpg
clematis | https://upload.wikimedia.org/wikipedia/commons/thumb/7/73/Clematis_%27Nelly_Moser%27.jpg/800px-Clematis_%27Nelly_Moser%27.jpg
wisteria | https://upload.wikimedia.org/wikipedia/commons/thumb/5/58/Wisteria_sinensis_in_Jena.jpg/800px-Wisteria_sinensis_in_Jena.jpg
ivy | https://upload.wikimedia.org/wikipedia/commons/thumb/9/9d/Hedera_helix_leaves.jpg/800px-Hedera_helix_leaves.jpg
pachysandra | https://upload.wikimedia.org/wikipedia/commons/thumb/3/36/Pachysandra_terminalis_02.jpg/800px-Pachysandra_terminalis_02.jpg
rhododendron | https://upload.wikimedia.org/wikipedia/commons/thumb/c/cb/Rhododendron_catawbiense_a4.jpg/800px-Rhododendron_catawbiense_a4.jpg
lantana | https://upload.wikimedia.org/wikipedia/commons/thumb/c/c1/Lantana_camara_flowers.jpg/800px-Lantana_camara_flowers.jpg
catmint | https://upload.wikimedia.org/wikipedia/commons/thumb/3/3d/Nepeta_faassenii2.jpg/800px-Nepeta_faassenii2.jpg
rose of sharon | https://upload.wikimedia.org/wikipedia/commons/thumb/a/a8/Hibiscus_syriacus_%27Oiseau_Bleu%27.jpg/800px-Hibiscus_syriacus_%27Oiseau_Bleu%27.jpg
nandina | https://upload.wikimedia.org/wikipedia/commons/thumb/0/0d/Nandina_domestica3.jpg/800px-Nandina_domestica3.jpg
agapanthus | https://upload.wikimedia.org/wikipedia/commons/thumb/3/3a/Agapanthus_africanus_-_Botanischer_Garten_Berlin.jpg/800px-Agapanthus_africanus_-_Botanischer_Garten_Berlin.jpg
mondo grass | https://upload.wikimedia.org/wikipedia/commons/thumb/3/3f/Ophiopogon_japonicus1.jpg/800px-Ophiopogon_japonicus1.jpg
mexican feather grass | https://upload.wikimedia.org/wikipedia/commons/thumb/b/b8/Nassella_tenuissima.jpg/800px-Nassella_tenuissima.jpg
coral bells | https://upload.wikimedia.org/wikipedia/commons/thumb/e/ec/Heuchera_%27Autumn_Leaves%27.jpg/800px-Heuchera_%27Autumn_Leaves%27.jpg
arborvitae | https://upload.wikimedia.org/wikipedia/commons/thumb/c/c0/Thuja_occidentalis_Smaragd1.jpg/800px-Thuja_occidentalis_Smaragd1.jpg
"""


def _cells(table: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split("|")] for line in table.strip().split("\n")]


def plant_rows() -> list[tuple]:
    photos: dict[str, list[str]] = {}
    for key, url in _cells(PHOTOS):
        photos.setdefault(key, []).append(url)
    return [(i, *cells, photos.get(cells[0], [])) for i, cells in enumerate(_cells(PLANTS))]


def genus_rows() -> list[tuple]:
    return list({cells[0]: tuple(c or None for c in cells) for cells in _cells(GENERA)}.values())


def plants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(plant_rows(), PLANT_SCHEMA)


def genera(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(genus_rows(), GENUS_SCHEMA)
