"""Sentences, names and street names that no part of the fitting sample has."""

FRAMES = {
    "en": {
        "email": ["Forward the minutes to {x}, please.", "My new e-mail is {x}; the old one is gone.", "Reach out to {x} for tickets."],
        "phone": ["Give me a ring on {x} tonight.", "WhatsApp: {x}", "For bookings telephone {x} and ask for Greta.", "Emergency line: {x}"],
        "id_number": ["He showed a passport with the number {x}.", "Tax identification: {x}", "Insurance no. {x} has lapsed."],
        "street_address": ["The bakery on the corner, {x}, closes early.", "Residence: {x}", "Post it to {x} before Friday."],
        "person_name": ["Professor {x} gave the lecture.", "Best wishes, {x}", "The photograph was taken by {x} in June.", "{x} told the press nothing.", "Applicant: {x}"],
    },
    "de": {
        "email": ["Das Protokoll geht an {x}.", "Meine neue E-Mail ist {x}."],
        "phone": ["Ruf mich heute Abend an: {x}", "Notruf: {x}", "Für Karten Telefon {x} wählen."],
        "id_number": ["Er legte einen Reisepass mit der Nummer {x} vor.", "Versicherungsnummer {x} ist erloschen."],
        "street_address": ["Die Bäckerei, {x}, schließt früh.", "Wohnsitz: {x}", "Schicken Sie es an die Adresse {x}."],
        "person_name": ["Professor {x} hielt den Vortrag.", "Herzliche Grüße, {x}", "Antragsteller: {x}", "Frau Dr. {x} kam später.", "{x} sagte der Presse nichts."],
    },
    "fr": {
        "email": ["Transmettez le compte rendu à {x}.", "Mon nouveau courriel est {x}."],
        "phone": ["Appelez-moi ce soir au {x}.", "Urgences, téléphone {x}"],
        "id_number": ["Il a montré un passeport portant le numéro {x}.", "Identité fiscale : {x}"],
        "street_address": ["La boulangerie, {x}, ferme tôt.", "Domicile, adresse : {x}"],
        "person_name": ["Le professeur {x} a fait la conférence.", "Bien à vous, {x}", "Monsieur {x} viendra demain.", "{x} a dit non à la presse."],
    },
    "es": {
        "email": ["Reenvíe el acta a {x}.", "Mi nuevo correo es {x}."],
        "phone": ["Llámame esta noche al {x}.", "Urgencias, teléfono {x}"],
        "id_number": ["Mostró un pasaporte con el número {x}.", "Identidad fiscal: {x}"],
        "street_address": ["La panadería, {x}, cierra pronto.", "Domicilio: dirección {x}"],
        "person_name": ["El profesor {x} dio la charla.", "Un saludo, {x}", "La señora {x} vendrá mañana.", "{x} no dijo nada a la prensa."],
    },
    "ru": {
        "email": ["Протокол перешлите на {x}.", "Моя новая почта {x}."],
        "phone": ["Позвони мне вечером: {x}", "Экстренный телефон {x}"],
        "id_number": ["Он показал паспорт с номером {x}.", "Страховой полис: {x}"],
        "street_address": ["Пекарня, {x}, закрывается рано.", "Место жительства, адрес: {x}"],
        "person_name": ["Профессор {x} прочитал лекцию.", "Всего доброго, {x}", "Господин {x} придёт завтра.", "{x} сказал прессе мало."],
    },
}
PLAIN = {
    "en": ["Flight {n} leaves at {d}:{d}{d}.", "The {c} reopened after the flood.", "Article {d}{d} of the {c} charter", "We counted {d}{d}{d} geese along {w}.", "{g} means strong.", "a {v} {v} by the {f} Tower", "Reference {n} applies.", "Temperature {d}{d}.{d} degrees", "The score was {d}{d}-{d}{d}."],
    "de": ["Flug {n} startet um {d}:{d}{d}.", "Das {c} ist nach der Flut wieder offen.", "Wir zählten {d}{d}{d} Gänse an {w}.", "Aktenzeichen {n} gilt.", "Der {f}-Turm ist hoch.", "Es stand {d}{d} zu {d}{d}."],
    "fr": ["Le vol {n} part à {d}h{d}{d}.", "Le {c} a rouvert après la crue.", "Nous avons compté {d}{d}{d} oies dans {w}.", "Référence {n}", "La tour {f} est haute."],
    "es": ["El vuelo {n} sale a las {d}:{d}{d}.", "El {c} reabrió tras la riada.", "Contamos {d}{d}{d} gansos en {w}.", "Referencia {n}", "La torre {f} es alta."],
    "ru": ["Рейс {n} вылетает в {d}:{d}{d}.", "{c} снова открыт.", "Мы насчитали {d}{d}{d} гусей на {w}.", "Башня {f} высока."],
}
GIVEN = "Oliver Charlotte Tobias Greta Mathieu Inès Álvaro Beatriz Nigel Harriet Lukas Frieda Gaspard Odile Rodrigo Pilar".split()
FAMILY = "Thompson Baxter Lindqvist Kowalski Zimmermann Vogel Perrin Chevalier Ortega Castillo Hartley Osborne Reinhardt Lombardi Vasquez Pritchard".split()
GIVEN_RU, FAMILY_RU = "Фёдор Марина Геннадий Лариса Тимофей Вера".split(), "Орлова Медведев Жуков Белова Воронцов Крылова".split()
STREETS = {"en": ["Juniper", "Cathedral", "Harvest", "Lincoln", "Saint Anne"], "de": ["Tannen", "Goethe", "Kloster", "Mühlen", "Hafen"], "fr": ["de Lyon", "des Acacias", "du Château", "Voltaire", "de la Mairie"], "es": ["de Sevilla", "Cervantes", "de la Fuente", "del Carmen", "Alta"], "ru": ["Гагарина", "Речная", "Чехова", "Берёзовая"]}
PLACES = {"x": ["Lake Windermere", "Silver Coast", "Holy Trinity", "National Gallery", "Blue Mountains", "Iron Works"], "ru": ["Зимний Дворец", "Верхняя Тура", "Третьяковская Галерея"]}
#: Text, and what is in it.
ORDINARY = [
    ("John Smith signed for it.", [("person_name", "John Smith")]),
    ("Mrs Angela Merkel spoke first.", [("person_name", "Angela Merkel")]),
    ("По словам Иван Петров, всё готово.", [("person_name", "Иван Петров")]),
    ("Dr. Oliver Baxter is on leave.", [("person_name", "Oliver Baxter")]),
    ("SSN 123-45-6789", [("id_number", "123-45-6789")]),
    ("National insurance number AB123456C", [("id_number", "AB123456C")]),
    ("Mobil 0171 2345678", [("phone", "0171 2345678")]),
    ("We live at 1234 Elm Blvd, Suite 200.", [("street_address", "1234 Elm Blvd, Suite 200")]),
    ("Anschrift: Friedrichstraße 123, 10117 Berlin", [("street_address", "Friedrichstraße 123")]),
    ("Address: 10 Downing Street, London", [("street_address", "10 Downing Street")]),
    ("Call (415) 867-5309 today.", [("phone", "(415) 867-5309")]),
    ("Tél. 04 72 10 30 30", [("phone", "04 72 10 30 30")]),
    ("Паспорт 4510 123456", [("id_number", "4510 123456")]),
    ("DNI 12345678Z", [("id_number", "12345678Z")]),
    ("Write to jane.doe@gmail.com soon.", [("email", "jane.doe@gmail.com")]),
    ("The Golden Gate Bridge opened in 1937.", []),
    ("Order 4415-7781 ships on 12/05/2024.", []),
    ("We met in New York on Monday Morning.", []),
]
