"""Reference lists for plausible values. ASCII, so that names are valid in e-mail addresses too."""

FIRST_NAMES = (
    "Adele Agathe Alban Amandine Anatole Armand Aurore Basile Benoit Blanche Bruno Carole Cedric Clement Coralie Damien Delphine Denis "
    "Edgar Elodie Estelle Fabien Fanny Florent Gaelle Gaspard Gilles Helene Herve Ines Irene Jerome Justine Karine Laurent Lucie "
    "Margaux Maxime Mathilde Noemie Octave Odile Pascal Quentin Regis Sabine Solene Tristan Valerie Xavier"
).split()
LAST_NAMES = (
    "Aubert Bailly Barbier Baron Benard Berger Besson Boucher Bourgeois Breton Brunet Carlier Charpentier Chevalier Collin Cordier "
    "Coulon Delattre Delorme Deschamps Dumas Etienne Faure Ferrand Gaillard Gautier Germain Gilbert Guyot Hamon Hubert Jacquet Joly "
    "Klein Lacroix Langlois Lebrun Leclercq Maillard Marchal Meunier Noel Pasquier Pelletier Poirier Prevost Renaud Rolland Tessier Vidal"
).split()
STREETS = [
    "allee des Acacias", "avenue du Marechal Foch", "boulevard Gambetta", "chemin du Lavoir", "cours Mirabeau", "impasse des Tilleuls",
    "place de la Mairie", "quai des Brumes", "route de Bordeaux", "rue de l'Abreuvoir", "rue de la Fontaine", "rue des Artisans",
    "rue des Peupliers", "rue du Chateau", "rue du Vieux Puits", "rue Jules Verne", "rue Pierre Curie", "rue Victor Schoelcher",
    "sentier des Vignes", "square Claude Debussy",
]
CITIES = [
    ("Ajaccio", "20000"), ("Albi", "81000"), ("Annecy", "74000"), ("Arras", "62000"), ("Auch", "32000"), ("Aurillac", "15000"), ("Auxerre", "89000"), ("Bastia", "20200"),
    ("Bayonne", "64100"), ("Belfort", "90000"), ("Blois", "41000"), ("Bourges", "18000"), ("Cahors", "46000"), ("Chartres", "28000"), ("Colmar", "68000"), ("Dax", "40100"),
    ("Dole", "39100"), ("Epinal", "88000"), ("Evreux", "27000"), ("Foix", "09000"), ("Gap", "05000"), ("Gueret", "23000"), ("Laon", "02000"), ("Laval", "53000"),
    ("Lens", "62300"), ("Macon", "71000"), ("Mende", "48000"), ("Montauban", "82000"), ("Morlaix", "29600"), ("Nevers", "58000"), ("Niort", "79000"), ("Orange", "84100"),
    ("Privas", "07000"), ("Quimper", "29000"), ("Rodez", "12000"), ("Saintes", "17100"), ("Tarbes", "65000"), ("Troyes", "10000"), ("Vannes", "56000"), ("Vesoul", "70000"),
]
